"""Flat, short and one-sided series, and kernels against plain versions."""

from itertools import permutations

import numpy as np
import pytest

from statewell.operators import hmm, portfolio, semi_markov
from statewell.operators import recursions as rec
from statewell.operators.performance import risk_by_state, tails, weighted_risk


def frame(spark, returns, posterior):
    rows = [(name, t, x, int(np.argmax(p)), p) for name, xs in returns.items() for t, (x, p) in enumerate(zip(xs, posterior(name)))]
    return spark.createDataFrame(rows, "series string, t long, ret double, state int, posterior array<double>")


@pytest.fixture(scope="module")
def odd(spark):
    r = np.random.default_rng(2)
    returns = {"flat": [0.0] * 40, "drop": [0.01] * 39 + [-0.2], "none": r.normal(0, 0.01, 40).tolist(), "short": [0.01, -0.01], "many": r.normal(0, 0.01, 400).tolist()}
    return frame(spark, returns, lambda name: [[1.0, 0.0]] * 400 if name == "none" else [[0.5, 0.5]] * 400)


def test_tails_of_odd_series(odd):
    """No division fails; what can't be fitted is empirical."""
    got = {(r.series, r.state): r for r in tails(odd, confidence=0.9).collect()}
    assert not got["flat", 0].fitted and got["flat", 0].var == 0 and got["flat", 0].es == pytest.approx(0)
    assert not got["drop", 0].fitted and got["drop", -1].es == pytest.approx(got["drop", 0].es)
    assert got["many", 0].fitted and not got["many", -1].fitted
    losses = sorted((-r.ret for r in odd.where("series = 'many'").collect()), reverse=True)
    assert got["many", -1].var == pytest.approx(losses[39]) and got["many", -1].es == pytest.approx(np.mean(losses[:40]))


def test_risk_of_odd_series(odd):
    got = {(r.series, r.state): r for r in weighted_risk(odd).collect()}
    assert got["flat", 0].sharpe is None and got["flat", 0].vol_ann == 0
    assert got["none", 1].mean_ann is None and got["none", 1].eff_n == 0
    assert got["short", 0].var is None
    x = np.array([r.ret for r in odd.where("series = 'many'").collect()])
    assert got["many", 0].sortino == pytest.approx(x.mean() / np.sqrt(np.mean(np.minimum(x, 0) ** 2)) * 8760**0.5)
    assert got["many", 0].max_drawdown == pytest.approx({r.series: r.max_drawdown for r in risk_by_state(odd).where("state = 0").collect()}["many"])


def test_alignment_is_best():
    r = np.random.default_rng(1)
    for k in (1, 2, 3, 5, 6):
        for _ in range(20):
            a, b = r.dirichlet(np.ones(k), 30), r.dirichlet(np.ones(k), 30)
            overlap = a.T @ b
            value = lambda p: sum(overlap[i, p[i]] for i in range(k))
            assert value(hmm.align(a, b)) == pytest.approx(max(map(value, permutations(range(k)))))


def test_fits_side_by_side_equal_single_ones():
    r = np.random.default_rng(3)
    x = np.r_[r.normal(-1, 0.3, (60, 2)), r.normal(1, 0.5, (60, 2))]
    for options in ({}, {"emission": "student_t"}, {"covariance": "diag"}):
        for m in hmm.fit_many(x, 2, [1, 2, 3], n_iter=20, **options):
            one = hmm.fit(x, 2, m["seed"], n_iter=20, **options)
            assert one["history"] == pytest.approx(m["history"]) and np.allclose(one["means"], m["means"])
            log_b, _ = hmm.log_density(x, m["means"], m["covs"], m["dofs"])
            ll, gamma, _ = hmm.expectations(log_b[None], m["start"][None], m["trans"][None])
            assert ll[0] == pytest.approx(rec.log_likelihood(log_b, m["start"], m["trans"]))
            assert np.allclose(gamma[0], rec.smooth(log_b, m["start"], m["trans"]))


def test_next_state_is_at_its_maximum():
    r = np.random.default_rng(5)
    x, k = r.normal(0, 1, (300, 2)), r.integers(0, 3, 300)
    model = semi_markov.NextState(lags=2).fit(x, k)
    a = model.rows(model.history(x)[:-1])
    slope = a.T @ (np.eye(3)[k[2:]] - model.shares(a)) / len(a) - model.l2 * model.coefficients
    assert np.abs(slope).max() < 1e-8
    assert np.array_equal(model.history(x)[0], np.r_[x[1], x[0]]) and len(model.predict(x)) == len(x) - 1


def test_drawdown_control_cuts_after_a_crash(spark):
    rows = [(s, t, 0.5, -0.3 if t == 2 else 0.0) for s in "ab" for t in range(5)]
    got = portfolio.drawdown_controlled(spark.createDataFrame(rows, "series string, t long, weight double, ret double")).orderBy("series", "t").collect()
    assert [r.scale for r in got][:5] == [1.0, 1.0, 0.0, 0.0, 0.0] and got[3].scaled == 0
