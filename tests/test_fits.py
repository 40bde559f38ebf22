"""Fits over blocks, tensor starts, concordance, GARCH, run lengths, stops and projections against plain versions."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from statewell.operators import dependence, hmm, moments, portfolio, scan
from statewell.operators import recursions as rec

CENTRES = np.array([[4.0, 1.0, 0.5], [0.5, 4.0, 1.0], [1.0, 0.5, 4.0]])


def planted(n, seed=0, stay=0.97):
    r = np.random.default_rng(seed)
    states, s = np.empty(n, int), 0
    for i in range(n):
        s = s if r.random() < stay else int(r.integers(3))
        states[i] = s
    return CENTRES[states] + r.normal(0, 0.5, (n, 3)), states


def by_first(means):
    return means[np.argsort(means[:, 0])]


def test_moments_hold_the_planted_means():
    x, _ = planted(20_000)
    m2, m3 = moments.numpy_moments(x / x.std(0))
    found = moments.tensor_means(m2, m3, 3, np.random.default_rng(1))
    assert np.allclose(by_first(found * x.std(0)), by_first(CENTRES), atol=0.4)
    assert moments.tensor_means(np.diag([1.0, 1.0, 0.0]), m3, 3, np.random.default_rng(1)) is None


@pytest.mark.parametrize("init", ["kmeans", "spectral", "tensor"])
def test_starts_lead_to_planted_states(init):
    x, states = planted(3000, 2)
    z, mean, sd = hmm.standardise(x)
    fit = max(hmm.fit_many(z, 3, [1, 2], init=init, mean=mean / sd), key=lambda m: m["log_likelihood"])
    assert np.allclose(by_first(fit["means"] * sd + mean), by_first(CENTRES), atol=0.1)
    # too many states for the features, and too few bars for the moments: spectral labels
    assert hmm.fit_many(z[:, :2], 3, [1], init=init, mean=(mean / sd)[:2]) and hmm.fit_many(z[:50], 2, [1], init=init, mean=mean / sd)


def test_blocks_give_the_moments_of_whole_series(spark):
    x, _ = planted(500, 3)
    frame = pd.DataFrame(x, columns=["a", "b", "c"]).assign(series="s", t=np.arange(500))
    m = moments.lagged_moments(scan.block_rows(spark.createDataFrame(frame), ["a", "b", "c"], 7), ["a", "b", "c"]).first()
    m2, m3 = moments.numpy_moments(x / x.std(0))
    assert np.allclose(m.m2, m2.ravel()) and np.allclose(m.m3, m3.ravel())


@pytest.mark.parametrize("init", ["kmeans", "tensor"])
def test_a_long_series_is_fitted_over_blocks(spark, init):
    x, states = planted(1500, 4, 0.9)
    names = ["a", "b", "c"]
    frame = pd.DataFrame(x, columns=names).assign(series="long", t=np.arange(1500))
    short = pd.DataFrame(x[:200], columns=names).assign(series="short", t=np.arange(200))
    df = spark.createDataFrame(pd.concat([frame, short]))
    options = {"n_iter": 12, "tol": 1e-2, "init": init}
    models = hmm.train(df, names, [3], 2, packed_bars=1000, **options).persist()
    whole = hmm.train(df, names, [3], 2, **options).collect()
    for row in models.collect():
        other = next(w for w in whole if w.series == row.series)
        mine, theirs = (hmm.from_json(m.model) for m in (row, other))
        assert math.isclose(row.log_likelihood, other.log_likelihood, rel_tol=1e-3) and row.n == other.n and row.finite_restarts == 2
        assert np.allclose(by_first(mine["means"]), by_first(theirs["means"]), atol=0.05)
    got = hmm.apply_models(df, models, names, packed_bars=1000).where("series = 'long'").toPandas().sort_values("t")
    same = hmm.apply_models(df, models, names).where("series = 'long'").toPandas().sort_values("t")
    assert got["state"].tolist() == same["state"].tolist()
    for name in ("smoothed", "filtered"):
        assert np.allclose(np.array(got[name].tolist()), np.array(same[name].tolist()))


@pytest.mark.parametrize("least", [8, 4096])
def test_concordance_with_ties(spark, least):
    r = np.random.default_rng(6)
    n = 300
    g = pd.DataFrame({"series": np.where(np.arange(n) < 250, "a", "b"), "t": np.arange(n), "x": r.integers(0, 12, n).astype(float), "y": r.integers(0, 5, n).astype(float)})
    g.loc[::3, "x"] = 0.0  # a third of the bars are tied
    p = r.dirichlet([1, 1], n)
    df = spark.createDataFrame(g.assign(posterior=p.tolist()))
    got = {(row.series, row.state): row.tau for row in dependence.kendall(df, "x", "y", least).collect()}
    for name, part in g.groupby("series"):
        w = p[part.index]
        for k in range(2):
            top = bottom = 0.0
            for (i, a), (j, b) in itertools.combinations(enumerate(part[["x", "y"]].to_numpy()), 2):
                ww = w[i, k] * w[j, k]
                top, bottom = top + ww * np.sign(a[0] - b[0]) * np.sign(a[1] - b[1]), bottom + ww
            assert math.isclose(got[name, k], top / bottom, abs_tol=1e-9)
    plan = dependence.kendall(df, "x", "y", least)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_gradient_is_that_of_differences():
    r = np.random.default_rng(7)
    x, g = r.normal(0, 0.01, 200), r.dirichlet([1, 1, 1], 200).T
    mu = np.array([0.0, 1e-3, -1e-3])
    at = np.array([[2e-5, 0.1, 0.7], [1e-5, 0.05, 0.9], [5e-5, 0.2, 0.3]])
    value, slope = rec.garch_loss(x, g, mu, *at.T)
    for k in range(3):
        v = rec.garch_variance(x, *at[k], mu[k])
        assert math.isclose(value[k], (g[k] * (0.5 * np.log(v) + 0.5 * (x - mu[k]) ** 2 / v)).sum())
        for i, h in enumerate((1e-9, 1e-6, 1e-6)):
            up, down = at.copy(), at.copy()
            up[k, i], down[k, i] = at[k, i] + h, at[k, i] - h
            difference = (rec.garch_loss(x, g, mu, *up.T)[0][k] - rec.garch_loss(x, g, mu, *down.T)[0][k]) / (2 * h)
            assert math.isclose(slope[k, i], difference, rel_tol=1e-3, abs_tol=1e-3)


def test_fits_beat_a_grid_and_fall_back():
    r = np.random.default_rng(8)
    v, x = 1e-4, np.empty(1500)
    for i in range(1500):
        x[i] = r.normal(0, math.sqrt(v))
        v = 1e-5 + 0.1 * x[i] ** 2 + 0.8 * v
    g = np.c_[np.ones(1500), r.random(1500), np.r_[np.ones(5), np.zeros(1495)]]
    fit = rec.fit_garch(x, g)
    assert fit["constant"].tolist() == [False, False, True] and fit["persistence"][2] == 0 and (fit["persistence"][:2] < 0.999).all()
    loss = lambda p: rec.garch_loss(x, g.T, fit["mu"], *(np.full(3, c) for c in p))[0]
    mine = rec.garch_loss(x, g.T, fit["mu"], fit["omega"], fit["alpha"], fit["beta"])[0]
    for p in itertools.product([1e-6, 5e-6, 1e-5, 2e-5, 5e-5], [0.02, 0.05, 0.1, 0.2], [0.3, 0.6, 0.75, 0.8, 0.9]):
        if p[1] + p[2] < 0.999:
            assert (mine[:2] <= loss(p)[:2] + 1e-6).all()


def test_dropped_run_lengths_are_reported():
    r = np.random.default_rng(9)
    x = np.r_[r.normal(0, 1, 120), r.normal(4, 1, 80)]
    dense, sparse = list(rec.run_length_posterior(x, least=0.0)), list(rec.run_length_posterior(x, least=1e-6))
    lost = np.cumsum([z for *_, z in sparse])
    assert all(len(n) == i + 2 for i, (n, *_) in enumerate(dense)) and max(len(n) for n, *_ in sparse) < 150
    for (n, p, _), (m, q, _), most in zip(dense, sparse, lost):
        full = dict(zip(n.tolist(), p))
        assert sum(abs(full[k] - v) for k, v in zip(m.tolist(), q)) <= 20 * most + 1e-9
    out = rec.run_lengths(x)
    assert out["run_length"][110] >= 100 and out["run_length"][-1] <= 82


def stops_by_hand(ret, state, targets, stops, takes, cost):
    held, wealth, entry, out = 0.0, 1.0, 1.0, []
    for x, k in zip(ret, state):
        known = 0 <= k < len(targets)
        want = targets[k] if known else 0.0
        gain = wealth / entry - 1
        if held != 0 and known and ((stops[k] is not None and gain <= -stops[k]) or (takes[k] is not None and gain >= takes[k])):
            want = 0.0
        net = held * x - cost * abs(want - held)
        out.append((wealth * (1 + net), net, held, want - held))
        if want and abs(want - held) > 1e-10:
            entry = wealth
        wealth, held = wealth * (1 + net), want
    return np.array(out).T


@pytest.mark.parametrize("ahead", [1, 7, 1024])
def test_stops_by_segments_are_stops_by_bars(ahead):
    r = np.random.default_rng(10)
    ret, state = r.normal(0, 0.02, 700), np.repeat(r.integers(0, 4, 70), 10)
    rules = ([0.0, 0.5, 1.0], [None, 0.03, 0.05], [0.04, None, 0.06])
    got = rec.stop_backtest(ret, state, *rules, ahead=ahead)
    for name, want in zip(("equity", "net", "position", "trade"), stops_by_hand(ret, state, *rules, 0.001)):
        assert np.allclose(got[name], want, atol=1e-12), name


def test_box_weights_are_the_nearest():
    r = np.random.default_rng(11)
    for _ in range(20):
        w, low, high = r.normal(0.3, 0.6, 4), 0.05, 0.6
        got = portfolio.box(w, low, high)
        assert math.isclose(got.sum(), 1, abs_tol=1e-9) and got.min() >= low - 1e-12 and got.max() <= high + 1e-12
        for _ in range(200):  # no other weights are nearer
            other = np.clip(r.dirichlet([1] * 4), low, high)
            other = portfolio.box(other, low, high)
            assert ((w - got) ** 2).sum() <= ((w - other) ** 2).sum() + 1e-9
    assert portfolio.box(np.array([1.0, 2.0]), 0.0, 0.3).tolist() == [0.5, 0.5]


def test_a_short_book_realises_when_it_covers():
    book = rec.Book(1000.0, slippage_bps=0.0)
    for target, price, realized in ((-2.0, 10.0, 0.0), (-3.0, 12.0, 0.0), (-1.0, 9.0, 2 * (32 / 3 - 9)), (1.0, 11.0, 2 * (32 / 3 - 9) + 32 / 3 - 11), (0.0, 12.0, 2 * (32 / 3 - 9) + 32 / 3 - 11 + 1)):
        book.trade_to(target, price)
        assert math.isclose(book.realized, realized, abs_tol=1e-9)
    assert math.isclose(book.cash - 1000.0, book.realized)


def test_drawdowns_over_blocks(spark):
    r = np.random.default_rng(12)
    x = r.normal(0, 0.02, 400)
    frame = pd.DataFrame({"series": "s", "t": np.arange(400), "x": x})
    down = portfolio.drawdowns(spark.createDataFrame(frame), "x", 37)
    got = portfolio.drawdown_scales(down, 23).join(down, ["series", "t"]).toPandas().sort_values("t")
    level = np.cumprod(1 + x)
    want = 1 - level / np.maximum.accumulate(level)
    assert np.allclose(got["drawdown"], want)
    stopped, scale = False, []
    for d in want:
        stopped = d > 0.03 if stopped else d >= 0.1
        scale.append(0.0 if stopped else max(0.0, 1 - (d - 0.05) / 0.05) if d >= 0.05 else 1.0)
    assert np.allclose(got["scale"], scale) and 0.0 in scale and 1.0 in scale


def test_two_lags_and_views(spark):
    from statewell.operators import panel

    r = np.random.default_rng(13)
    n, a, b = 400, np.array([[0.4, 0.2], [0.0, 0.3]]), np.array([[-0.2, 0.0], [0.3, 0.1]])
    x = np.zeros((n, 2))
    for i in range(2, n):
        x[i] = a @ x[i - 1] + b @ x[i - 2] + r.normal(0, 0.01, 2)
    frame = pd.DataFrame([{"series": s, "t": t, "ret": x[t, j]} for j, s in enumerate("pq") for t in range(n)])
    rows, names = panel.side_by_side(spark.createDataFrame(frame), (-1.0, 1.0), 1.0, lags=2)
    got = {(g.response, g.cause, g.lag): g.coefficient for g in panel.autoregression(rows, names, 2).where("state = -1").collect()}
    z = np.c_[np.ones(n - 2), x[1:-1], x[:-2]]
    want = np.linalg.lstsq(z, x[2:], rcond=None)[0]
    for i, name in enumerate(names):
        for j, key in enumerate([("", 0), ("p", 1), ("q", 1), ("p", 2), ("q", 2)]):
            assert math.isclose(got[name, *key], want[j, i], abs_tol=2e-3)
    # a view pulls its own asset, as surely as it is trusted
    prior, cov = np.array([0.1, 0.2]), np.diag([4.0, 9.0])
    pulls = [portfolio.black_litterman(prior, cov, np.array([1.0, 0.0]), np.array([c, 0.0]), 0.05, p) for c, p in ((1.0, None), (5.0, None), (1.0, [0.5, 0.5]), (0.0, None))]
    assert np.allclose(pulls[0], pulls[1]) and np.allclose(pulls[3], prior) and np.allclose([p[1] for p in pulls], 0.2)
    assert math.isclose(pulls[0][0], (0.1 / 0.2 + 1) / (1 / 0.2 + 1), rel_tol=1e-6) and prior[0] < pulls[2][0] < pulls[0][0]


def test_the_next_state_fit_has_no_slope_left():
    from statewell.operators import semi_markov

    r = np.random.default_rng(14)
    x, k = r.normal(0, 1, (300, 2)), r.integers(0, 3, 300)
    k[1:] = np.where(r.random(299) < 0.5, (x[:-1, 0] > 0) + (x[:-1, 1] > 0), k[1:])
    model = semi_markov.NextState(lags=2, l2=0.01).fit(x, k)
    a = model.rows(model.history(x)[:-1])
    hit = (k[2:, None] == np.arange(3)).astype(float)
    slope = a.T @ (hit - model.shares(a)) / len(a) - model.l2 * model.coefficients
    assert np.abs(slope).max() < 1e-10
