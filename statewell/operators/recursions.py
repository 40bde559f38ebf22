"""Kernels of recursions over one series, on NumPy arrays; see ``functions.fold``."""

from __future__ import annotations

import math

import numpy as np


def logsumexp(a: np.ndarray, axis: int | None = None) -> np.ndarray:
    m = np.max(a, axis=axis, keepdims=True)
    m = np.where(np.isfinite(m), m, 0)
    out = np.log(np.exp(a - m).sum(axis=axis, keepdims=True)) + m
    return out.squeeze() if axis is None else out.squeeze(axis)


def online_filter(log_b: np.ndarray, start: np.ndarray, trans: np.ndarray, carry: np.ndarray | None = None) -> np.ndarray:
    """Causal state probabilities. The transition is applied before every bar, the first too."""
    log_a = np.log(np.maximum(trans, 1e-300))
    s = np.log(np.maximum(start, 1e-300)) if carry is None else carry
    s = s - logsumexp(s)
    out = np.empty_like(log_b)
    for i, b in enumerate(log_b):
        s = b + logsumexp(log_a + s[:, None], 0)
        s = s - logsumexp(s)
        out[i] = s
    return np.exp(out)


def forward(log_b: np.ndarray, start: np.ndarray, trans: np.ndarray, carry: np.ndarray | None = None) -> np.ndarray:
    """Log weights of all paths so far. ``carry`` is that of the bar before the first, if there is one."""
    with np.errstate(divide="ignore"):
        log_a, alpha = np.log(trans), np.empty_like(log_b)
        alpha[0] = log_b[0] + (np.log(start) if carry is None else logsumexp(carry[:, None] + log_a, 0))
    for i in range(1, len(log_b)):
        alpha[i] = log_b[i] + logsumexp(alpha[i - 1][:, None] + log_a, 0)
    return alpha


def log_likelihood(log_b: np.ndarray, start: np.ndarray, trans: np.ndarray) -> float:
    return float(logsumexp(forward(log_b, start, trans)[-1]))


def backward(log_b: np.ndarray, trans: np.ndarray, after: np.ndarray | float = 0.0) -> np.ndarray:
    """Log weights of all paths from here on; ``after`` is that of the last bar."""
    with np.errstate(divide="ignore"):
        log_a = np.log(trans)
    beta = np.zeros_like(log_b)
    beta[-1] = after
    for i in range(len(log_b) - 2, -1, -1):
        beta[i] = logsumexp(log_a + log_b[i + 1] + beta[i + 1], 1)
    return beta


def smooth(log_b: np.ndarray, start: np.ndarray, trans: np.ndarray) -> np.ndarray:
    g = forward(log_b, start, trans) + backward(log_b, trans)
    return np.exp(g - logsumexp(g, 1)[:, None])


def viterbi(log_b: np.ndarray, start: np.ndarray, trans: np.ndarray, carry: np.ndarray | None = None, last: int | None = None) -> np.ndarray:
    """The likeliest path. ``carry``: weights of the bar before the first; ``last``: the state to end in."""
    with np.errstate(divide="ignore"):
        log_a = np.log(trans)
        v = log_b[0] + (np.log(start) if carry is None else (carry[:, None] + log_a).max(0))
    back = np.zeros(log_b.shape, int)
    for i in range(1, len(log_b)):
        step = v[:, None] + log_a
        back[i] = step.argmax(0)
        v = step.max(0) + log_b[i]
    path = np.empty(len(log_b), int)
    path[-1] = v.argmax() if last is None else last
    for i in range(len(log_b) - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def gaussian_log_density(x: np.ndarray, means: np.ndarray, sds: np.ndarray) -> np.ndarray:
    z = (x[:, None] - means) / sds
    return -0.5 * z * z - np.log(sds) - 0.5 * math.log(2 * math.pi)


def ema(x: np.ndarray, alpha: np.ndarray | float) -> np.ndarray:
    """Exponential average from the first value on; missing values carry the last."""
    alpha = np.broadcast_to(alpha, x.shape)
    out, y = np.empty(len(x)), math.nan
    for i, v in enumerate(x):
        y = v if math.isnan(y) else y if math.isnan(v) else alpha[i] * v + (1 - alpha[i]) * y
        out[i] = y
    return out


def state_alpha(posterior: np.ndarray, half_lives: list[float]) -> np.ndarray:
    """A bar's smoothing factor: those of the first states, as many as there are half-lives, by their probabilities."""
    k = 1 - np.exp(-math.log(2) / np.maximum(half_lives, 1e-6))
    w = posterior[:, : len(k)]
    return (w / (w.sum(1, keepdims=True) + 1e-15)) @ k


def garch_variance(r: np.ndarray, omega: float, alpha: float, beta: float, mu: float) -> np.ndarray:
    out = np.empty(len(r))
    for i in range(len(r)):
        out[i] = max(r.var(), 1e-8) if i == 0 else max(omega + alpha * (r[i - 1] - mu) ** 2 + beta * out[i - 1], 1e-12)
    return out


def garch_forecast(omega: float, alpha: float, beta: float, mu: float, last_return: float, last_sd: float, horizons) -> list[float]:
    """Deviations ahead: by the closed form if the process is stationary, else step by step."""
    one, persistence, out = omega + alpha * (last_return - mu) ** 2 + beta * last_sd**2, alpha + beta, []
    for h in horizons:
        if persistence < 1:
            level = omega / (1 - persistence)
            v = level + persistence**h * (last_sd**2 - level)
        else:
            v = one
            for _ in range(h - 1):
                v = omega + persistence * v
        out.append(math.sqrt(max(v, 1e-12)))
    return out


def linear_recurrence(u: np.ndarray, beta: np.ndarray, first: np.ndarray, block: int = 64) -> np.ndarray:
    """y with y[:, 0] = first and y[:, t] = beta y[:, t - 1] + u[:, t], for each row.

    A block of bars is one product with the powers of beta, so the loop is over blocks.
    """
    k, n = u.shape
    out = np.empty((k, n))
    out[:, 0], last = first, first
    lag = np.subtract.outer(np.arange(block), np.arange(block))
    with np.errstate(divide="ignore", invalid="ignore"):
        powers = np.where(lag >= 0, beta[:, None, None] ** np.maximum(lag, 0), 0.0)
        carry = beta[:, None] ** np.arange(1, block + 1)
    for lo in range(1, n, block):
        part = u[:, lo : lo + block]
        m = part.shape[1]
        y = np.matmul(powers[:, :m, :m], part[:, :, None])[:, :, 0] + carry[:, :m] * last[:, None]
        out[:, lo : lo + m], last = y, y[:, -1]
    return out


def garch_loss(r: np.ndarray, gamma: np.ndarray, mu: np.ndarray, omega: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted negative log likelihood of each state (a row of ``gamma``) and its gradient by omega, alpha, beta.

    Variance and its three derivatives are linear recurrences in beta.
    """
    e2 = (r - mu[:, None]) ** 2
    before = np.concatenate([np.zeros((len(mu), 1)), e2[:, :-1]], 1)
    zero = np.zeros(len(mu))
    v = linear_recurrence(omega[:, None] + alpha[:, None] * before, beta, np.full(len(mu), max(r.var(), 1e-8)))
    v = np.maximum(v, 1e-12)
    lagged = np.concatenate([np.zeros((len(mu), 1)), v[:, :-1]], 1)
    loss = (gamma * (0.5 * np.log(v) + 0.5 * e2 / v)).sum(1)
    slope = gamma * 0.5 * (1 / v - e2 / v**2)
    return loss, np.stack([(slope * linear_recurrence(u, beta, zero)).sum(1) for u in (np.ones_like(v), before, lagged)], 1)


def minimise(f, x: np.ndarray, rounds: int) -> np.ndarray:
    """Minima of several functions at once by BFGS: ``f`` gives values and gradients of all rows of ``x``."""
    n, d = x.shape
    value, slope = f(x)
    inverse = np.repeat(np.eye(d)[None], n, 0)
    for _ in range(rounds):
        step = -np.einsum("nij,nj->ni", inverse, slope)
        down = np.einsum("ni,ni->n", step, slope)
        uphill = ~(down < 0)
        step[uphill], inverse[uphill] = -slope[uphill], np.eye(d)
        down = np.einsum("ni,ni->n", step, slope)
        step *= np.minimum(1.0, 2.0 / (np.abs(step).max(1) + 1e-300))[:, None]
        size, found = np.ones(n), np.zeros(n, bool)
        new, new_value, new_slope = x.copy(), value.copy(), slope.copy()
        for _ in range(40):  # until each row is well below where it was
            trial = np.where(found[:, None], new, x + size[:, None] * step)
            v, g = f(trial)
            good = ~found & np.isfinite(v) & (v <= value + 1e-4 * size * np.minimum(down, 0))
            new[good], new_value[good], new_slope[good] = trial[good], v[good], g[good]
            found |= good
            if found.all():
                break
            size = np.where(found, size, size / 2)
        moved, turned = new - x, new_slope - slope
        curve = np.einsum("ni,ni->n", moved, turned)
        for i in np.flatnonzero(curve > 1e-12):
            rho, eye = 1 / curve[i], np.eye(d)
            left = eye - rho * np.outer(moved[i], turned[i])
            inverse[i] = left @ inverse[i] @ left.T + rho * np.outer(moved[i], moved[i])
        gained = value - new_value
        x, value, slope = new, new_value, new_slope
        if not (gained > 1e-10 * (1 + np.abs(value))).any():
            break
    return x


def fit_garch(r: np.ndarray, gamma: np.ndarray, rounds: int = 200, least: float = 10.0) -> dict[str, np.ndarray]:
    """Weighted likelihood fits of all states side by side; ``gamma`` is (bars, states).

    alpha + beta stays below 0.999 by the parametrisation. A state of less weight than
    ``least`` bars, without variance, or whose fit is not finite has a constant one: alpha = beta = 0.
    """
    g = np.atleast_2d(gamma.T).astype(float)
    w = g.sum(1)
    safe = np.maximum(w, 1e-300)
    mu = np.where(w > 0, (g * r).sum(1) / safe, 0.0)
    var = np.where(w > 0, (g * (r - mu[:, None]) ** 2).sum(1) / safe, 0.0)
    floor = np.maximum(var, 1e-8)

    def parts(p):
        with np.errstate(over="ignore"):
            s, u = 1 / (1 + np.exp(-p[:, 1])), 1 / (1 + np.exp(-p[:, 2]))
        return np.exp(np.minimum(p[:, 0], 50.0)) + 1e-12, 0.999 * s * u, 0.999 * s * (1 - u), s, u

    def loss(p):
        omega, alpha, beta, s, u = parts(p)
        value, by = garch_loss(r, g, mu, omega, alpha, beta)
        by_s, by_u = by[:, 1] * u + by[:, 2] * (1 - u), (by[:, 1] - by[:, 2]) * s
        return value, np.stack([by[:, 0] * (omega - 1e-12), 0.999 * by_s * s * (1 - s), 0.999 * by_u * u * (1 - u)], 1)

    start = np.stack([np.log(0.05 * floor), np.full(len(w), math.log(0.951 / 0.049)), np.full(len(w), math.log(0.105 / 0.895))], 1)
    best = minimise(loss, start, rounds) if len(r) > 1 else start
    omega, alpha, beta, _, _ = parts(best)
    flat = (w < least) | (var < 1e-14) | ~np.isfinite(best).all(1)
    omega, alpha, beta = np.where(flat, floor, omega), np.where(flat, 0.0, alpha), np.where(flat, 0.0, beta)
    return {"omega": omega, "alpha": alpha, "beta": beta, "mu": mu, "persistence": alpha + beta, "constant": flat}


def weighted_volatility(r: np.ndarray, gamma: np.ndarray, omega, alpha, beta, mu) -> np.ndarray:
    """Each bar's mean over the states of their conditional deviations, weighted by ``gamma``."""
    vols = [np.sqrt(garch_variance(r, *p)) for p in zip(omega, alpha, beta, mu)]
    return (gamma * np.stack(vols, 1)).sum(1)


def kalman_level_velocity(y: np.ndarray, r: float | None = None, q: float = 1e-4, p0: float = 1.0, dt: float = 1.0) -> dict[str, np.ndarray]:
    """Level and velocity from zero; a missing observation is predicted over."""
    r = float(np.nanvar(y)) if r is None else r
    f, x, p = np.array([[1, dt], [0, 1]]), np.zeros(2), np.eye(2) * p0
    out = np.zeros((len(y), 4))
    for i, v in enumerate(y):
        x, p = f @ x, f @ p @ f.T + q * np.eye(2)
        s = p[0, 0] + r
        e = 0.0
        if not math.isnan(v):
            e, k = v - x[0], p[:, 0] / s
            x, p = x + k * e, p - np.outer(k, p[0])
        out[i] = x[0], p[0, 0], e, s
    return dict(zip(("level", "variance", "innovation", "innovation_variance"), out.T))


def kalman_smoother(y: np.ndarray, q: np.ndarray, r: float) -> np.ndarray:
    """Random walk with a process noise for each bar: forward filter, backward smoothing."""
    n = len(y)
    x, p, before, ahead = np.empty(n), np.empty(n), np.empty(n), np.empty(n)
    for i in range(n):
        before[i] = y[0] if i == 0 else x[i - 1]
        ahead[i] = q.mean() + r if i == 0 else p[i - 1] + q[i]
        if i == 0:
            x[i], p[i] = y[0], ahead[i]
            continue
        g = ahead[i] / (ahead[i] + r + 1e-15)
        x[i], p[i] = before[i] + g * (y[i] - before[i]), (1 - g) * ahead[i]
    out = x.copy()
    for i in range(n - 2, -1, -1):
        out[i] = x[i] + p[i] / (ahead[i + 1] + 1e-15) * (out[i + 1] - before[i + 1])
    return out


def hp_trend(y: np.ndarray, lam: float) -> np.ndarray:
    """Solves (I + lam D'D) trend = y, five diagonals, without pivoting (the matrix is positive definite)."""
    n = len(y)
    if n < 3:
        return y.astype(float)
    a, b, c = np.ones(n), np.zeros(n), np.zeros(n)  # diagonal, first and second above it
    for i in range(n - 2):
        a[i : i + 3] += lam * np.array([1, 4, 1])
        b[i : i + 2] += lam * np.array([-2, -2])
        c[i] += lam
    z = y.astype(float).copy()
    d, u, v = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n):
        d[i] = a[i] - (u[i - 1] ** 2 * d[i - 1] if i > 0 else 0) - (v[i - 2] ** 2 * d[i - 2] if i > 1 else 0)
        u[i] = (b[i] - (d[i - 1] * u[i - 1] * v[i - 1] if i > 0 else 0)) / d[i]
        v[i] = c[i] / d[i]
        z[i] -= (u[i - 1] * z[i - 1] if i > 0 else 0) + (v[i - 2] * z[i - 2] if i > 1 else 0)
    z /= d
    for i in range(n - 2, -1, -1):
        z[i] -= u[i] * z[i + 1] + (v[i] * z[i + 2] if i + 2 < n else 0)
    return z


def run_length_posterior(x: np.ndarray, hazard: float = 1 / 200, kappa0: float = 1.0, alpha0: float = 1.0, beta0: float | None = None, mu0: float = 0.0, least: float = 1e-12):
    """For each bar: run lengths, their probabilities, and the probability that was dropped at this bar.

    Run lengths less likely than ``least`` are dropped, so memory doesn't grow with the
    square of the series. A missing value counts as the last one.
    """
    beta0 = max(float(np.nanvar(x)), 1e-8) * alpha0 if beta0 is None else beta0
    length, run, mu, kappa, alpha, beta = np.zeros(1, np.int64), np.ones(1), np.array([mu0]), np.array([kappa0]), np.array([alpha0]), np.array([beta0])
    last = mu0
    lg = np.vectorize(math.lgamma, otypes=[float])
    for v in x:
        v = last = last if math.isnan(v) else float(v)
        dof, scale2 = 2 * alpha, beta * (kappa + 1) / (alpha * kappa)
        pred = np.exp(lg((dof + 1) / 2) - lg(dof / 2) - 0.5 * np.log(dof * math.pi * scale2) - (dof + 1) / 2 * np.log1p((v - mu) ** 2 / (dof * scale2)))
        grown, fresh = pred * run * (1 - hazard), pred[0] * hazard
        prob = np.r_[fresh, grown]
        whole = prob.sum()
        prob = prob / whole if whole > 1e-300 else np.r_[1.0, np.zeros(len(prob) - 1)]
        length = np.r_[0, length + 1]
        new = ((kappa * mu + v) / (kappa + 1), kappa + 1, alpha + 0.5, beta + 0.5 * kappa * (v - mu) ** 2 / (kappa + 1))
        mu, kappa, alpha, beta = (np.r_[p, a] for p, a in zip((mu0, kappa0, alpha0, beta0), new))
        keep = prob >= least
        keep[0] = True
        yield length[keep], prob[keep], float(prob[~keep].sum())
        length, run, mu, kappa, alpha, beta = length[keep], prob[keep], mu[keep], kappa[keep], alpha[keep], beta[keep]


def bocpd(x: np.ndarray, **prior) -> np.ndarray:
    """Probability of a change at each bar."""
    return np.array([p[0] for _, p, _ in run_length_posterior(x, **prior)])


def run_lengths(x: np.ndarray, **prior) -> dict[str, np.ndarray]:
    """At each bar: probability of a change, likeliest and mean run length, and probability dropped so far at most."""
    rows = [(p[0], n[p.argmax()], (n * p).sum(), lost) for n, p, lost in run_length_posterior(x, **prior)]
    change, likeliest, mean, lost = (np.array(c) for c in zip(*rows)) if rows else (np.zeros(0),) * 4
    return {"change_probability": change, "run_length": likeliest, "mean_run_length": mean, "lost": np.cumsum(lost)}


def change_points(prob: np.ndarray, threshold: float = 0.3, least: int = 10) -> np.ndarray:
    """Marks bars at or over ``threshold``, at least ``least`` bars after the last mark."""
    out, last = np.zeros(len(prob), bool), -(10**9)
    for i in np.flatnonzero(prob >= threshold):
        if i - last >= least:
            out[i], last = True, i
    return out


def drawdown_scale(drawdown: np.ndarray, most: float = 0.1, soft: float = 0.05, recovery: float = 0.03, stopped: bool = False) -> tuple[np.ndarray, bool]:
    """Exposure by drawdown (positive): less from ``soft`` on, none from ``most`` until it recovers; and whether it ends stopped.

    A bar at ``most`` or beyond stops, one at ``recovery`` or less frees, others leave things
    as they are: a bar is as the last of these bars before it, or as it begins.
    """
    sets = np.where(drawdown >= most, 1, np.where(drawdown <= recovery, 0, -1))
    last = np.maximum.accumulate(np.where(sets >= 0, np.arange(len(sets)), -1))
    held = np.where(last >= 0, sets[last], int(stopped)).astype(bool)
    eased = np.where(drawdown >= soft, np.maximum(0.0, 1 - (drawdown - soft) / (most - soft + 1e-15)), 1.0)
    return np.where(held, 0.0, eased), bool(held[-1]) if len(held) else stopped


def stop_backtest(ret: np.ndarray, state: np.ndarray, targets: list[float], stops: list[float | None], takes: list[float | None], cost: float = 0.001, ahead: int = 1024) -> dict[str, np.ndarray]:
    """Equity, net return, position and trade of each bar, with a target for each state.

    An open position is closed where its gain since entry is outside (-stop, take) of the
    bar's state. Positions earn from the next bar on; a state without a rule has target 0.

    Between two trades a position is constant, so its wealth is a running product. The
    bars up to the next trade are found and filled at once, ``ahead`` bars at a time.
    """
    n, known = len(ret), len(targets)
    rule = np.where((state >= 0) & (state < known), state, known).astype(int)
    of = lambda values, default, sign: np.array([default if v is None else sign * v for v in values] + [default], float)[rule]
    target, low, high = of(targets, 0.0, 1), of(stops, -math.inf, -1), of(takes, math.inf, 1)
    net, held, trade = np.zeros(n), np.zeros(n), np.zeros(n)
    wealth, entry, position, i = 1.0, 1.0, 0.0, 0
    while i < n:
        end = min(i + ahead, n)
        # wealth before each of the next bars, if nothing is traded until then
        level = wealth * np.cumprod(np.r_[1.0, 1 + position * ret[i:end]])
        gain = level[:-1] / entry - 1
        closed = (position != 0) & ((gain <= low[i:end]) | (gain >= high[i:end]))
        wanted = np.where(closed, 0.0, target[i:end])
        moves = np.flatnonzero(wanted != position)
        quiet = int(moves[0]) if len(moves) else end - i
        held[i : i + quiet], net[i : i + quiet] = position, position * ret[i : i + quiet]
        wealth, i = float(level[quiet]), i + quiet
        if quiet == end - (i - quiet):
            continue
        change = float(wanted[quiet]) - position
        held[i], trade[i] = position, change
        net[i] = position * ret[i] - cost * abs(change)
        if wanted[quiet] and abs(change) > 1e-10:
            entry = wealth
        wealth, position, i = wealth * (1 + net[i]), float(wanted[quiet]), i + 1
    return {"equity": np.cumprod(1 + net), "net": net, "position": held, "trade": trade}


def alerts(state: np.ndarray, posterior: np.ndarray, sure: float = 0.6, cooldown: int = 3) -> np.ndarray:
    """Marks changes of state that are likely enough and not too soon after the last alert."""
    out, prev, since, fired = np.zeros(len(state), bool), None, 0, False
    for i, k in enumerate(state):
        since += 1
        if prev is not None and k != prev and posterior[i, k] >= sure and (not fired or since > cooldown):
            out[i], since, fired = True, 0, True
        prev = k
    return out


class Book:
    """Cash, position and profit of a paper account."""

    def __init__(self, cash: float = 100_000.0, slippage_bps: float = 5.0, commission: float = 0.0) -> None:
        self.cash, self.position, self.average, self.realized = cash, 0.0, 0.0, 0.0
        self.slip, self.commission, self.trades = slippage_bps / 1e4, commission, 0

    def trade_to(self, target: float, price: float) -> float:
        """Trades up or down to ``target`` units; returns the traded quantity."""
        change = target - self.position
        if abs(change) < 1e-10:
            return 0.0
        fill = price * (1 + self.slip if change > 0 else 1 - self.slip)
        self.cash -= change * fill + self.commission
        if self.position * change < 0:  # closes some or all
            closed = min(abs(change), abs(self.position))
            self.realized += closed * (fill - self.average) * (1 if self.position > 0 else -1)
            if abs(change) > abs(self.position):
                self.average = fill
        else:
            self.average = (abs(self.position) * self.average + abs(change) * fill) / (abs(self.position) + abs(change))
        self.position, self.trades = target, self.trades + 1
        if abs(self.position) < 1e-12:
            self.position = self.average = 0.0
        return change

    def value(self, price: float) -> float:
        return self.cash + self.position * price


def paper_trading(price: np.ndarray, state: np.ndarray, weights: dict[int, float], least_change: float = 0.01, warmup: int = 0, **account) -> dict[str, np.ndarray]:
    """Holds the weight of each state's rule; trades where the weight changes enough."""
    book, prev = Book(**account), None
    out = {k: np.zeros(len(price)) for k in ("equity", "position", "realized")}
    for i, (px, k) in enumerate(zip(price, state)):
        if i >= warmup:
            w = weights.get(int(k), 0.0)
            if prev is None or abs(w - weights.get(prev, 0.0)) > least_change:
                book.trade_to(book.value(px) * w / px, px)
            prev = int(k)
        out["equity"][i], out["position"][i], out["realized"][i] = book.value(px), book.position, book.realized
    return out


def switching_levels(y: np.ndarray, posterior: np.ndarray) -> dict[str, np.ndarray]:
    """Levels filtered with each state's observation variance, and their blend by the posterior."""
    w = posterior / posterior.sum(0)
    var = ((y[:, None] - (w * y[:, None]).sum(0)) ** 2 * w).sum(0)
    levels = np.stack([kalman_level_velocity(y, max(float(v), 1e-12))["level"] for v in var], 1)
    return {"level": (posterior * levels).sum(1), "levels": levels}


def hp_blend(y: np.ndarray, posterior: np.ndarray, lambdas: list[float]) -> np.ndarray:
    """Trends with each state's smoothness, blended by the posterior."""
    trends = np.stack([hp_trend(y, x) for x in lambdas], 1)
    w = posterior[:, : len(lambdas)]
    return (w * trends).sum(1) / (w.sum(1) + 1e-15)
