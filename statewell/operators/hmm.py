"""Hidden Markov models by expectation maximisation.

A fit is a chain, so it is one task; Spark spreads (series, states) over tasks and a task
fits its restarts side by side.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import moments
from . import recursions as rec

#: Bars of a series beyond which fits and decoding run over its blocks, and bars that a fit then starts from.
PACKED_BARS, START_BARS = 200_000, 20_000
FLOOR = 1e-4
DOF_LOW, DOF_HIGH, DOF_START = 2.001, 200.0, 5.0


def standardise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd > 0, sd, 1.0)
    return (x - mean) / sd, mean, sd


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 50) -> np.ndarray:
    """Labels, started by k-means++."""
    centres = [x[rng.integers(len(x))]]
    for _ in range(k - 1):
        d = np.min([((x - c) ** 2).sum(1) for c in centres], 0)
        centres.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
    c = np.array(centres)
    for _ in range(rounds):
        label = ((x[:, None] - c) ** 2).sum(2).argmin(1)
        new = np.array([x[label == i].mean(0) if (label == i).any() else c[i] for i in range(k)])
        if np.allclose(new, c):
            break
        c = new
    return label


def spectral_labels(x: np.ndarray, k: int, rng: np.random.Generator, lagged: np.ndarray | None = None) -> np.ndarray:
    """k-means on the leading left singular directions of the lag-one cross products; on ``x`` itself if k > d."""
    if k > x.shape[1]:
        return kmeans(x, k, rng)
    u, _, _ = np.linalg.svd(x[:-1].T @ x[1:] / (len(x) - 1) if lagged is None else lagged)
    return kmeans(x @ u[:, :k], k, rng)


def tensor_labels(x: np.ndarray, k: int, rng: np.random.Generator, mean: np.ndarray, sums: tuple[np.ndarray, np.ndarray, int] | None = None) -> np.ndarray:
    """The nearest of the means that lagged moments hold; ``mean`` is that of features scaled by their deviations.

    Spectral labels if k > d, with fewer than 10 d^2 bars, or if the moments hold fewer
    than k components. ``sums`` are the moments and bars of a longer series ``x`` was taken from.
    """
    d = x.shape[1]
    m2, m3, bars = sums or (*moments.numpy_moments(x + mean), len(x))
    found = moments.tensor_means(m2, m3, k, rng) if k <= d and bars >= 10 * d * d else None
    if found is None:
        return spectral_labels(x, k, rng)
    return ((x[:, None] - (found - mean)) ** 2).sum(2).argmin(1)


def n_parameters(k: int, d: int, covariance: str = "full", emission: str = "gaussian") -> int:
    cov = {"full": k * d * (d + 1) // 2, "diag": k * d, "tied": d * (d + 1) // 2, "spherical": k}[covariance]
    return k * (k - 1) + k - 1 + k * d + cov + (k if emission == "student_t" else 0)


def reduce_covariance(covs: np.ndarray, weight: np.ndarray, kind: str) -> np.ndarray:
    d = covs.shape[1]
    if kind == "diag":
        covs = np.array([np.diag(np.diag(c)) for c in covs])
    elif kind == "spherical":
        covs = np.array([np.eye(d) * np.trace(c) / d for c in covs])
    elif kind == "tied":
        covs = np.repeat((weight[:, None, None] * covs).sum(0, keepdims=True) / weight.sum(), len(covs), 0)
    elif kind != "full":
        raise ValueError(f"covariance is full, diag, tied or spherical, not {kind!r}")
    return covs + FLOOR * np.eye(d)


def log_density(x: np.ndarray, means: np.ndarray, covs: np.ndarray, dofs: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Log densities and squared distances of each state."""
    d, logs, maha = x.shape[1], [], []
    for k, (m, c) in enumerate(zip(means, covs)):
        root = np.linalg.cholesky(c)
        q = (np.linalg.solve(root, (x - m).T) ** 2).sum(0)
        logdet = 2 * np.log(np.diag(root)).sum()
        if dofs is None:
            logs.append(-0.5 * (d * math.log(2 * math.pi) + logdet + q))
        else:
            v = dofs[k]
            logs.append(math.lgamma((v + d) / 2) - math.lgamma(v / 2) - 0.5 * (d * math.log(v * math.pi) + logdet) - (v + d) / 2 * np.log1p(q / v))
        maha.append(q)
    return np.array(logs).T, np.array(maha).T


def digamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out, x = out - 1 / x, x + 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f / 252))


def update_dof(c: float) -> float:
    """Root of ln(v/2) - digamma(v/2) + 1 + c on the allowed range; its end if there is none."""
    g = lambda v: math.log(v / 2) - digamma(v / 2) + 1 + c
    lo, hi = DOF_LOW, DOF_HIGH
    if g(lo) <= 0:
        return lo
    if g(hi) >= 0:
        return hi
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if g(mid) > 0 else (lo, mid)
    return (lo + hi) / 2


def next_dofs(dofs: np.ndarray, level: np.ndarray, d: int) -> np.ndarray:
    """Degrees of freedom from the states' means of ln u - u."""
    return np.array([update_dof(float(c) + digamma((v + d) / 2) - math.log((v + d) / 2)) for c, v in zip(level, dofs)])


def first_guess(x: np.ndarray, k: int, seed: int, covariance: str, emission: str, init: str, mean: np.ndarray | None = None, sums: tuple | None = None) -> dict:
    """A model to start from, of scaled data; ``mean`` and ``sums`` are for init "tensor"."""
    rng = np.random.default_rng(seed)
    if init == "tensor":
        label = tensor_labels(x, k, rng, np.zeros(x.shape[1]) if mean is None else mean, sums)
    else:
        label = {"kmeans": kmeans, "spectral": spectral_labels}[init](x, k, rng)
    weight = np.array([(label == i).sum() for i in range(k)], float)
    means = np.array([x[label == i].mean(0) if weight[i] else x.mean(0) for i in range(k)])
    whole = np.atleast_2d(np.cov(x.T))
    covs = np.array([np.atleast_2d(np.cov(x[label == i].T)) if weight[i] > x.shape[1] else whole for i in range(k)])
    return {
        "k": k,
        "seed": seed,
        "history": [],
        "converged": False,
        "start": np.full(k, 1 / k),
        "trans": np.full((k, k), 0.1 / k) + 0.9 * np.eye(k),
        "means": means,
        "covs": reduce_covariance(covs, np.maximum(weight, 1), covariance),
        "dofs": np.full(k, DOF_START) if emission == "student_t" else None,
    }


def expectations(log_b: np.ndarray, start: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log likelihood, state and summed transition probabilities of several models over one series.

    ``log_b`` is (models, bars, states). Probabilities are scaled to one at each bar, so a
    bar is two small products for all models at once.
    """
    top = log_b.max(2, keepdims=True)
    b = np.exp(log_b - top)
    n = b.shape[1]
    alpha, beta, scale = np.empty_like(b), np.ones_like(b), np.empty(b.shape[:2])
    ahead = start * b[:, 0]
    for i in range(n):
        if i:
            ahead = np.matmul(alpha[:, i - 1, None], trans)[:, 0] * b[:, i]
        scale[:, i] = ahead.sum(1)
        alpha[:, i] = ahead / scale[:, i, None]
    share = b / scale[:, :, None]
    for i in range(n - 2, -1, -1):
        beta[:, i] = np.matmul(trans, (share[:, i + 1] * beta[:, i + 1])[:, :, None])[:, :, 0]
    gamma = alpha * beta
    gamma /= gamma.sum(2, keepdims=True)
    moves = trans * np.einsum("rti,rtj->rij", alpha[:, :-1], (share * beta)[:, 1:])
    return np.log(scale).sum(1) + top.sum((1, 2)), gamma, moves


def improve(model: dict, x: np.ndarray, maha: np.ndarray, gamma: np.ndarray, moves: np.ndarray, covariance: str) -> None:
    """The parameters that fit the expected states best."""
    d, dofs = x.shape[1], model["dofs"]
    first = np.maximum(gamma[0], 1e-12)
    moves = np.maximum(moves, 1e-12)
    u = np.ones_like(gamma) if dofs is None else (dofs + d) / (dofs + maha)
    n, w = gamma.sum(0) + 1e-12, gamma * u
    means = (w.T @ x) / (w.sum(0)[:, None] + 1e-12)
    covs = np.array([((x - m) * w[:, [i]]).T @ (x - m) / n[i] for i, m in enumerate(means)])
    model |= {"start": first / first.sum(), "trans": moves / moves.sum(1, keepdims=True), "means": means, "covs": reduce_covariance(covs, n, covariance)}
    if dofs is not None:
        model["dofs"] = next_dofs(dofs, (gamma * (np.log(u) - u)).sum(0) / n, d)


def fit_many(x: np.ndarray, k: int, seeds: list[int], covariance: str = "full", emission: str = "gaussian", init: str = "kmeans", n_iter: int = 200, tol: float = 1e-4, mean: np.ndarray | None = None) -> list[dict]:
    """A fit of scaled data for each seed, side by side: parameters, log likelihood, its history.

    A fit leaves once it has converged or failed; failed ones are not returned.
    """
    done, live = [], [first_guess(x, k, s, covariance, emission, init, mean) for s in seeds]
    for _ in range(n_iter):
        ready = []
        for m in live:
            try:
                m["density"] = log_density(x, m["means"], m["covs"], m["dofs"])
                ready.append(m)
            except (np.linalg.LinAlgError, ValueError, FloatingPointError):
                pass  # a failed restart is no candidate
        live = ready
        if not live:
            break
        ll, gamma, moves = expectations(*(np.stack([m["density"][0] if c == "density" else m[c] for m in live]) for c in ("density", "start", "trans")))
        left = []
        for m, value, g, v in zip(live, ll.tolist(), gamma, moves):
            m["converged"] = bool(m["history"]) and value - m["history"][-1] < tol
            m["history"].append(value)
            if not math.isfinite(value):
                continue
            if m["converged"]:
                done.append(m)
                continue
            improve(m, x, m["density"][1], g, v, covariance)
            left.append(m)
        live = left
    out = done + live
    for m in out:
        m.pop("density", None)
        m["log_likelihood"] = m["history"][-1]
    return sorted(out, key=lambda m: m["seed"])


def best_of(fits: list[dict], group) -> list[dict]:
    """The likeliest of the fits of each group."""
    best: dict = {}
    for m in fits:
        if group(m) not in best or m["log_likelihood"] > best[group(m)]["log_likelihood"]:
            best[group(m)] = m
    return list(best.values())


def fit(x: np.ndarray, k: int, seed: int = 42, **options) -> dict:
    """One fit of scaled data."""
    found = fit_many(x, k, [seed], **options)
    if not found:
        raise ValueError("the fit failed")
    return found[0]


def to_json(model: dict) -> str:
    return json.dumps({a: b.tolist() if isinstance(b, np.ndarray) else b for a, b in model.items()})


def from_json(text: str) -> dict:
    model = json.loads(text)
    if not isinstance(model, dict) or "trans" not in model:
        raise TypeError("not a fitted model")
    return {a: np.array(b) if a in ("start", "trans", "means", "covs", "dofs", "mean", "sd") and b is not None else b for a, b in model.items()}


def decode(model: dict, x: np.ndarray) -> dict[str, np.ndarray]:
    """Viterbi path, smoothed and causally filtered probabilities of unscaled data."""
    log_b, _ = log_density((x - model["mean"]) / model["sd"], model["means"], model["covs"], model["dofs"])
    return {"state": rec.viterbi(log_b, model["start"], model["trans"]), "smoothed": rec.smooth(log_b, model["start"], model["trans"]), "filtered": rec.online_filter(log_b, model["start"], model["trans"])}


def long_series(df: DataFrame, bars: int) -> DataFrame:
    return df.groupBy("series").count().where(F.col("count") > bars).select("series")


def train(df: DataFrame, features: list[str], counts: list[int], restarts: int = 10, seed: int = 42, criterion: str = "bic", packed_bars: int = PACKED_BARS, **options) -> DataFrame:
    """The best fit of every series and state count: series, k, log_likelihood, aic, bic, n_params, converged, model (JSON), chosen.

    ``chosen`` marks each series' least criterion; of ties the smallest count. A failed
    restart is no candidate. A series of up to ``packed_bars`` bars is packed into one row,
    which goes to a task for each count; its restarts are fitted there side by side. The rounds
    of a longer one are Spark jobs over its blocks (``scan.fit_long``).
    """
    if criterion not in ("aic", "bic"):
        raise ValueError(f"criterion is aic or bic, not {criterion!r}")
    if not counts or min(counts) < 2:
        raise ValueError("state counts start at 2")
    bar = F.struct("t", F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
    long = long_series(df, packed_bars)
    any_long = not long.isEmpty()
    packed = (df.join(long, "series", "left_anti") if any_long else df).groupBy("series").agg(F.array_sort(F.collect_list(bar)).alias("bars"))
    jobs = packed.select("series", F.col("bars.x").alias("x"), F.explode(F.array(*[F.lit(k) for k in counts])).alias("k"))
    names = ["series", "k", "log_likelihood", "converged", "model", "n", "finite_restarts", "converged_restarts"]

    def run(batches):
        for jobs in batches:
            rows = []
            for series, bars, k in jobs.itertuples(index=False):
                x, mean, sd = standardise(np.array([v.tolist() for v in bars], float))
                fits = fit_many(x, int(k), [seed + i for i in range(restarts)], mean=mean / sd, **options) if len(x) > 1 else []
                if fits:
                    best = max(fits, key=lambda m: m["log_likelihood"])
                    model = to_json(best | {"mean": mean, "sd": sd, "features": features})
                    rows.append((series, int(k), best["log_likelihood"], best["converged"], model, len(x), len(fits), sum(m["converged"] for m in fits)))
            yield pd.DataFrame(rows, columns=names)

    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    fits = jobs.repartition(tasks, "series", "k").mapInPandas(run, "series string, k int, log_likelihood double, converged boolean, model string, n long, finite_restarts long, converged_restarts long")
    if any_long:
        from .scan import fit_long

        fits = fits.unionByName(fit_long(df.join(long, "series", "left_semi"), features, counts, restarts, seed, **options))
    params = F.create_map(*[x for k in counts for x in (F.lit(k), F.lit(n_parameters(k, len(features), options.get("covariance", "full"), options.get("emission", "gaussian"))))])
    rows = fits.withColumn("n_params", params[F.col("k")])
    rows = rows.withColumn("aic", 2 * F.col("n_params") - 2 * F.col("log_likelihood")).withColumn("bic", F.col("n_params") * F.ln("n") - 2 * F.col("log_likelihood"))
    least = F.min(F.struct(criterion, "k")).over(Window.partitionBy("series"))
    return rows.withColumn("chosen", F.col("k") == least["k"])


def apply_models(df: DataFrame, models: DataFrame, features: list[str], packed_bars: int = PACKED_BARS) -> DataFrame:
    """series, t, state, smoothed and filtered of each series under its chosen model; longer ones by blocks."""
    chosen = models.where("chosen").select("series", "model")
    long, blocks = long_series(df, packed_bars), None
    if not long.isEmpty():
        from . import scan

        rows = scan.block_rows(df.join(long, "series", "left_semi"), features)
        blocks = scan.decode(rows, chosen.join(long, "series", "left_semi").withColumn("id", F.lit(""))).drop("id")
        df = df.join(long, "series", "left_anti")

    def run(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t", kind="stable")
        if not len(rows) or not len(model):
            return pd.DataFrame({"series": [], "t": [], "state": [], "smoothed": [], "filtered": []}, dtype=object)
        out = decode(from_json(model["model"].iloc[0]), rows[features].to_numpy(float))
        return pd.DataFrame({"series": rows["series"], "t": rows["t"], "state": out["state"], "smoothed": out["smoothed"].tolist(), "filtered": out["filtered"].tolist()})

    out = df.select("series", "t", *features).groupBy("series").cogroup(chosen.groupBy("series")).applyInPandas(run, "series string, t long, state int, smoothed array<double>, filtered array<double>")
    return out if blocks is None else out.unionByName(blocks)


def align(reference: np.ndarray, other: np.ndarray) -> tuple[int, ...]:
    """The order of ``other``'s states that overlaps most with ``reference``'s: shortest augmenting paths, O(k^3)."""
    cost = -(reference.T @ other)
    k = len(cost)
    row_price, column_price = np.zeros(k + 1), np.zeros(k + 1)
    owner = np.zeros(k + 1, int)  # of each column, 1-based; column 0 is where a path starts
    for row in range(1, k + 1):
        owner[0], column = row, 0
        far, back, seen = np.full(k + 1, np.inf), np.zeros(k + 1, int), np.zeros(k + 1, bool)
        while owner[column]:
            seen[column] = True
            free = np.flatnonzero(~seen)
            reach = cost[owner[column] - 1, free - 1] - row_price[owner[column]] - column_price[free]
            closer = reach < far[free]
            far[free[closer]], back[free[closer]] = reach[closer], column
            target = free[far[free].argmin()]
            step = far[target]
            row_price[owner[seen]] += step
            column_price[seen] -= step
            far[free] -= step
            column = target
        while column:
            owner[column] = owner[back[column]]
            column = back[column]
    out = np.empty(k, int)
    out[owner[1:] - 1] = np.arange(k)
    return tuple(out.tolist())


def ensemble(df: DataFrame, features: list[str], k: int, models: int = 5, restarts: int = 3, seed: int = 42, step: int = 100, **options) -> DataFrame:
    """series, t, posterior, entropy, agreement: mean of aligned models of each series with different seeds.

    A model is the best of ``restarts`` fits; all fits of a series run side by side.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("t", kind="stable")
        x, mean, sd = standardise(group[features].to_numpy(float))
        fits = best_of(fit_many(x, k, [seed + i * step + j for i in range(models) for j in range(restarts)], **options), lambda m: (m["seed"] - seed) // step)
        fits.sort(key=lambda m: -m["log_likelihood"])
        posts = [decode(m | {"mean": mean, "sd": sd}, group[features].to_numpy(float))["smoothed"] for m in fits]
        p = np.mean([posts[0]] + [q[:, align(posts[0], q)] for q in posts[1:]], 0)
        h = -(p * np.log(p + 1e-10)).sum(1)
        return pd.DataFrame({"series": group["series"], "t": group["t"], "posterior": p.tolist(), "entropy": h, "agreement": np.clip(1 - h / math.log(k), 0, 1)})

    return df.select("series", "t", *features).groupBy("series").applyInPandas(run, "series string, t long, posterior array<double>, entropy double, agreement double")


def rank_labels(means: np.ndarray) -> list[str]:
    """Names of states by their rank of return."""
    names = {2: ["bearish", "bullish"], 3: ["low", "mid", "high"]}.get(len(means)) or [str(i) for i in range(len(means))]
    order = np.argsort(np.argsort(means, kind="stable"), kind="stable")
    return [names[i] for i in order]
