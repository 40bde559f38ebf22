"""Recursions and small algebra against closed forms and plain versions."""

import math

import numpy as np
import pytest

from statewell.operators import dense, hmm, portfolio, semi_markov
from statewell.operators import recursions as rec
from statewell.operators import states as st

# the ice-cream example of textbooks: 3 1 3
START, TRANS = np.array([0.8, 0.2]), np.array([[0.6, 0.4], [0.5, 0.5]])
EMIT = np.array([[0.2, 0.4, 0.4], [0.5, 0.4, 0.1]])
LOG_B = np.log(EMIT[:, [2, 0, 2]].T)


def test_ice_cream():
    assert math.isclose(rec.log_likelihood(LOG_B, START, TRANS), math.log(0.028562), abs_tol=1e-5)
    assert rec.viterbi(LOG_B, START, TRANS).tolist() == [0, 1, 0]
    assert np.allclose(rec.smooth(LOG_B, START, TRANS), [[0.9366, 0.0634], [0.3961, 0.6039], [0.8226, 0.1774]], atol=1e-4)


def test_online_filter_predicts_first_and_carries_on():
    p = START @ TRANS * np.exp(LOG_B[0])
    got = rec.online_filter(LOG_B, START, TRANS)
    assert np.allclose(got[0], p / p.sum())
    rest = rec.online_filter(LOG_B[1:], START, TRANS, np.log(got[0]))
    assert np.allclose(rest, got[1:])


def test_hp_trend_solves_its_equation():
    y = np.random.default_rng(1).normal(size=40).cumsum()
    d = np.diff(np.eye(40), 2, axis=0)
    assert np.allclose(rec.hp_trend(y, 1600.0), np.linalg.solve(np.eye(40) + 1600 * d.T @ d, y))
    assert rec.hp_trend(y[:2], 10).tolist() == y[:2].tolist()


def test_kalman_skips_missing():
    y = np.array([1.0, np.nan, 3.0])
    out = rec.kalman_level_velocity(y, 1.0)
    assert out["innovation"][1] == 0 and np.isfinite(out["level"]).all()
    smooth = rec.kalman_smoother(np.full(30, 5.0), np.full(30, 1e-3), 0.01)
    assert np.allclose(smooth, 5.0)


def test_bocpd_finds_a_shift():
    rng = np.random.default_rng(2)
    x = np.r_[rng.normal(0, 0.01, 150), rng.normal(0.3, 0.01, 150)]
    p = rec.bocpd(x)
    marks = np.flatnonzero(rec.change_points(p, 0.2, 10))
    assert any(148 <= m <= 155 for m in marks) and ((p >= 0) & (p <= 1)).all()


def test_garch():
    r = np.random.default_rng(3).normal(0, 0.01, 300)
    v = rec.garch_variance(r, 1e-6, 0.1, 0.8, 0.0)
    assert math.isclose(v[1], max(1e-6 + 0.1 * r[0] ** 2 + 0.8 * v[0], 1e-12))
    fit = rec.fit_garch(r, np.ones(300))
    assert fit["persistence"] < 0.999 and fit["omega"] > 0
    far = rec.garch_forecast(1e-6, 0.1, 0.8, 0.0, 0.0, 0.02, [1, 10_000])
    assert far[0] > far[1] and math.isclose(far[1] ** 2, 1e-5, rel_tol=1e-6)


def test_drawdown_scale_has_hysteresis():
    d = np.array([0.0, 0.05, 0.075, 0.1, 0.06, 0.031, 0.03, 0.04])
    assert np.allclose(rec.drawdown_scale(d)[0], [1, 1, 0.5, 0, 0, 0, 1, 1])


def test_stop_and_take():
    out = rec.stop_backtest(np.array([0.0, -0.05, 0.0, 0.1]), np.zeros(4, int), [1.0], [0.04], [None], 0.0)
    assert out["position"].tolist() == [0, 1, 1, 0]


def test_alert_cooldown():
    state = np.array([0, 1, 0, 1, 1, 1, 0])
    sure = np.eye(2)[state]
    assert np.flatnonzero(rec.alerts(state, sure, 0.6, 3)).tolist() == [1, 6]
    assert not rec.alerts(state, sure * 0.5, 0.6, 3).any()


def test_book():
    b = rec.Book(1000.0, 0.0)
    b.trade_to(10, 10)
    b.trade_to(20, 20)
    assert b.average == 15 and b.value(20) == 1100
    b.trade_to(-5, 25)
    assert b.realized == 200 and b.average == 25
    b.trade_to(0, 20)
    assert b.realized == 225 and b.value(1) == 1225


def test_ema():
    assert rec.ema(np.array([1.0, math.nan, 3.0]), 0.5).tolist() == [1, 1, 2]


def planted(seed=0, n=500):
    rng = np.random.default_rng(seed)
    s = np.zeros(n, int)
    for i in range(1, n):
        s[i] = s[i - 1] if rng.random() < 0.95 else 1 - s[i - 1]
    return s, np.c_[rng.normal(np.where(s, 2, -1), 0.7), rng.normal(0, 1, n)]


@pytest.mark.parametrize("emission", ["gaussian", "student_t"])
@pytest.mark.parametrize("covariance", ["full", "diag", "tied", "spherical"])
def test_likelihood_rises(emission, covariance):
    _, x = planted(n=300)
    m = hmm.fit(hmm.standardise(x)[0], 2, emission=emission, covariance=covariance, n_iter=30)
    assert (np.diff(m["history"]) > -1e-2).all() and np.isfinite(m["log_likelihood"])


@pytest.mark.parametrize("init", ["kmeans", "spectral"])
def test_states_are_recovered(init):
    s, x = planted()
    z, mean, sd = hmm.standardise(x)
    m = hmm.fit(z, 2, init=init) | {"mean": mean, "sd": sd}
    m = hmm.from_json(hmm.to_json(m))
    path = hmm.decode(m, x)["state"]
    counts = np.array([[((path == i) & (s == j)).sum() for j in (0, 1)] for i in (0, 1)])
    assert dense.rand_index(counts) > 0.8
    with pytest.raises(TypeError):
        hmm.from_json("[]")


def test_parameter_counts():
    assert hmm.n_parameters(3, 2) == 6 + 2 + 6 + 9
    assert hmm.n_parameters(2, 3, "tied", "student_t") == 2 + 1 + 6 + 6 + 2
    assert hmm.align(np.eye(3), np.eye(3)[:, [2, 0, 1]]) == (1, 2, 0)
    assert math.isclose(hmm.digamma(1.0), -0.5772156649, abs_tol=1e-8)


def test_transitions():
    a = np.array([[0.9, 0.1], [0.4, 0.6]])
    assert np.allclose(st.stationary(a), [0.8, 0.2]) and np.allclose(st.power(a, 500)[0], [0.8, 0.2])
    assert np.allclose(st.expected_dwell(a), [10, 2.5]) and np.isclose(st.additional_dwell(a, 0), 9)
    assert st.additional_dwell(np.eye(2), 0) == 200 and np.isclose(st.occupancy(a, 0, 1)[0], 0.9)
    assert np.isclose(st.entropy_rate(a), 0.8 * st.row_entropy(a)[0] + 0.2 * st.row_entropy(a)[1])


def test_gaussian_distances():
    m, c, m2, c2 = np.zeros(1), np.eye(1), np.ones(1), 4 * np.eye(1)
    assert np.isclose(dense.kl(m, c, m2, c2), math.log(2) + (1 + 1) / 8 - 0.5)
    assert dense.kl(m, c, m, c) == 0 and dense.symmetric_kl(m, c, m2, c2) == dense.symmetric_kl(m2, c2, m, c)
    assert np.isnan(dense.kl(m, -c, m2, c2)) and dense.bhattacharyya(m, c, m, c) == 0


def test_var_of_one_series_is_least_squares():
    x = np.zeros(400)
    rng = np.random.default_rng(5)
    for i in range(1, 400):
        x[i] = 0.2 + 0.6 * x[i - 1] + rng.normal()
    z = np.c_[x[1:], x[:-1]]
    a, b, _ = dense.var_model(z.mean(0), np.cov(z.T, ddof=0), 1, 1, 0.0)
    slope, level = np.polyfit(x[:-1], x[1:], 1)
    assert np.isclose(b[0, 0, 0], slope) and np.isclose(a[0], level)
    assert np.allclose(dense.impulse_response(b, np.eye(1), 0, 2).ravel(), [1, slope, slope**2])


def test_portfolios():
    cov = np.diag([1.0, 4.0])
    assert np.allclose(portfolio.min_variance(cov), [0.8, 0.2])
    assert np.isclose(portfolio.max_sharpe(np.array([0.1, 0.1]), cov).sum(), 1)
    assert np.allclose(portfolio.black_litterman(np.ones(2), cov, np.zeros(2), np.zeros(2)), 1)
    sizes, done = portfolio.order_schedule(100.0)
    assert np.isclose(sum(sizes), 100) and 0 <= done < 10
    assert portfolio.twap(10, 4) == [2.5] * 4 and np.isclose(sum(portfolio.drawdown_budget([1, -1, 3])), 0.1)
    assert len(portfolio.frontier(np.array([0.1, 0.2]), cov, 5)) == 5


def test_durations():
    assert semi_markov.duration_log_pmf(0, 1, 0.5) == -math.inf
    assert np.isclose(sum(math.exp(semi_markov.duration_log_pmf(d, 2.0, 0.4)) for d in range(1, 200)), 1)
    p = semi_markov.correct(np.array([0, 0, 1]), np.full((3, 2), 0.5), [(2.0, 0.4), (1.0, 0.3)])
    assert np.allclose(p.sum(1), 1)


def test_next_state():
    s, x = planted()
    p = semi_markov.NextState().fit(x, s).predict(x)
    assert p.shape == (500, 2) and (p[:-1].argmax(1) == s[1:]).mean() > 0.85
    assert np.allclose(semi_markov.blend(np.full((500, 2), 0.5), p).sum(1), 1)
