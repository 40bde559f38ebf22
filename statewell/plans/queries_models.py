"""Fitted models, simulation and replays; SQL can't express the fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fold import fold
from ..functions.posterior import gaussian_posterior
from ..functions.rolling import order
from ..operators import dense, factors, hmm, semi_markov, simulation, stability, walk_forward
from ..operators import panel as side_by_side
from ..operators import portfolio as pf
from ..operators import recursions as rec
from ..operators.performance import Backtest, tails
from ..sources import bars
from ..streaming.trading import Live, replay
from .base import CENTRES, SD, STATES, query, r, rounded, states
from .queries_core import _FILTER, MEANS, SDS, START, TRANS
from .queries_more import _N, PANEL, panel

Spark = SparkSession
_FEATURES = ["log_return", "volatility_w24"]
#: State counts to choose from, and most rounds of a fit; it ends earlier at its tolerance.
COUNTS, ROUNDS = [2, 3, 4, 5, 6], 1000


@query()
def hmm_fit_select(spark: Spark, sf: str) -> DataFrame:
    out = hmm.train(states(spark, sf), _FEATURES, COUNTS, n_iter=ROUNDS)
    return out.select("series", "k", "log_likelihood", "aic", "bic", "n_params", "finite_restarts", "converged_restarts", "chosen")


@query()
def hmm_decode(spark: Spark, sf: str) -> DataFrame:
    df = states(spark, sf)
    return hmm.apply_models(df, hmm.train(df, _FEATURES, COUNTS, n_iter=ROUNDS), _FEATURES)


@query()
def student_t_fit(spark: Spark, sf: str) -> DataFrame:
    return hmm.train(states(spark, sf), _FEATURES, [2], n_iter=ROUNDS, emission="student_t", init="spectral").drop("model")


@query()
def ensemble(spark: Spark, sf: str) -> DataFrame:
    return hmm.ensemble(states(spark, sf), _FEATURES, 2, n_iter=ROUNDS)


@query()
def fit_stability(spark: Spark, sf: str) -> DataFrame:
    return stability.across_seeds(states(spark, sf), _FEATURES, 2, n_iter=ROUNDS)


_WF = """WITH RECURSIVE b AS (SELECT epoch(o_orderdate)::BIGINT AS t FROM orders WHERE o_totalprice > 0 GROUP BY 1), sp AS (SELECT min(t) AS first, max(t) AS last FROM b),
m AS (SELECT first, last, epoch(unnest(range(date_trunc('month', to_timestamp(first)::TIMESTAMP), to_timestamp(last)::TIMESTAMP + INTERVAL 1 MICROSECOND, INTERVAL 1 MONTH)))::BIGINT + first % 86400 AS boundary FROM sp),
f AS (SELECT row_number() OVER (ORDER BY boundary) - 1 AS fold, boundary - 180 * 86400 AS start, boundary, coalesce(lead(boundary) OVER (ORDER BY boundary), last + 3600) AS stop FROM m WHERE boundary >= first + 180 * 86400 AND boundary <= last)
SELECT 'all' AS series, fold::INT AS fold, boundary, sum((t < boundary)::INT)::BIGINT AS train_bars, sum((t >= boundary)::INT)::BIGINT AS oos_bars FROM f JOIN b ON t >= start AND t < stop GROUP BY 1, 2, 3"""


@query(_WF)
def walk_forward_folds(spark: Spark, sf: str) -> DataFrame:
    return walk_forward.fold_counts(bars.daily_orders(spark, sf))


@query()
def walk_forward_backtest(spark: Spark, sf: str) -> DataFrame:
    df = bars.daily_orders(spark, sf).withColumn("ret", F.ln(F.col("close") / F.lag("close").over(order())) / 100).where("ret is not null")
    out = walk_forward.walk_forward_backtest(df, ["ret"], 2, Backtest(bars_per_year=365.0), restarts=5, n_iter=ROUNDS)
    return out.select("series", "t", "fold", "state", "signal", "net", "equity")


@query()
def simulate_paths(spark: Spark, sf: str) -> DataFrame:
    paths = simulation.gaussian_paths(spark, [[0.001], [-0.002]], [[[1e-4]], [[4e-4]]], [[0.95, 0.05], [0.1, 0.9]], [0.5, 0.5])
    return simulation.path_stats(paths)


@query()
def simulate_garch_paths(spark: Spark, sf: str) -> DataFrame:
    params = [{"omega": 1e-6, "alpha": 0.1, "beta": 0.8}, {"omega": 1e-6, "alpha": 0.15, "beta": 0.8}]
    return simulation.scenario_stats(simulation.garch_paths(spark, params, [[0.9, 0.1], [0.1, 0.9]], [0.5, 0.5]))


@query()
def stress_losses(spark: Spark, sf: str) -> DataFrame:
    rows = tails(states(spark, sf)).where("fitted").groupBy("state").agg(F.avg("threshold").alias("threshold"), F.avg("xi").alias("xi"), F.avg("sigma").alias("sigma")).orderBy("state").collect()
    return simulation.stress(spark, [x.asDict() for x in rows], [1 / max(1, len(rows))] * len(rows))


@query()
def garch_fit(spark: Spark, sf: str) -> DataFrame:
    """Parameters of each series and state; the states of a series are fitted side by side."""
    import pandas as pd

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t", kind="stable")
        out = rec.fit_garch(g["ret"].to_numpy(), np.array(g["posterior"].tolist()))
        return pd.DataFrame({"series": g["series"].iloc[0], "state": range(len(out["mu"]))} | out)

    return states(spark, sf).select("series", "t", "ret", "posterior").groupBy("series").applyInPandas(run, "series string, state int, omega double, alpha double, beta double, mu double, persistence double, constant boolean")


#: Fixed omega, alpha, beta and mean of three states.
_GARCH = ([1e-5, 2e-5, 4e-5], [0.1, 0.05, 0.15], [0.8, 0.9, 0.7], [0.0002, 0.0, -0.0003])


@query(STATES + _N + f""", gp AS (SELECT unnest([0, 1, 2]) AS k, unnest({_GARCH[0]}) AS om, unnest({_GARCH[1]}) AS al, unnest({_GARCH[2]}) AS be, unnest({_GARCH[3]}) AS mu),
v AS (SELECT series, greatest(var_pop(ret), 1e-8) AS v FROM s GROUP BY 1),
g AS (SELECT o.series, o.t, o.n, gp.*, v.v AS s2, o.ret FROM o JOIN v USING (series), gp WHERE n = 1
UNION ALL SELECT o.series, o.t, o.n, k, om, al, be, mu, greatest(om + al * power(g.ret - mu, 2) + be * g.s2, 1e-12), o.ret FROM g JOIN o ON o.series = g.series AND o.n = g.n + 1)
SELECT series, t, {r('sum(w * sqrt(s2))', 9)} AS vol FROM g JOIN e USING (series, t, k) GROUP BY 1, 2""")
def garch_weighted_vol(spark: Spark, sf: str) -> DataFrame:
    """Volatility of each bar over the states of fixed processes, weighted by its posterior."""
    out = fold(states(spark, sf), lambda x, p: {"vol": rec.weighted_volatility(x, p, *_GARCH)}, ["ret", "posterior"], {"vol": "double"})
    return rounded(out, 9)


_PRED = "exp(lgamma(alpha + 0.5) - lgamma(alpha) - 0.5 * ln(2 * alpha * pi() * beta * (kappa + 1) / (alpha * kappa)) - (alpha + 0.5) * ln(1 + power(x - mu, 2) / (2 * alpha * beta * (kappa + 1) / (alpha * kappa))))"


_RUNS = STATES + _N + f""", bo AS (SELECT series, 0::BIGINT AS n, 0::BIGINT AS t, 0::BIGINT AS run, 1.0::DOUBLE AS p, 0.0::DOUBLE AS mu, 1.0::DOUBLE AS kappa, 1.0::DOUBLE AS alpha, b0 AS beta, b0 FROM (SELECT series, greatest(var_pop(log_return), 1e-8) AS b0 FROM s GROUP BY 1)
UNION ALL SELECT series, n, t, run, q / sum(q) OVER (PARTITION BY series), mu, kappa, alpha, beta, b0 FROM (
SELECT series, n, t, b0, CASE WHEN grows THEN run + 1 ELSE 0 END AS run, pred * CASE WHEN grows THEN p * (1 - 1 / 200.0) ELSE 1 / 200.0 END::DOUBLE AS q, CASE WHEN grows THEN (kappa * mu + x) / (kappa + 1) ELSE 0 END AS mu,
CASE WHEN grows THEN kappa + 1 ELSE 1 END AS kappa, CASE WHEN grows THEN alpha + 0.5 ELSE 1 END AS alpha, CASE WHEN grows THEN beta + 0.5 * kappa * power(x - mu, 2) / (kappa + 1) ELSE b0 END AS beta
FROM (SELECT o.series, o.n, o.t, x, run, p, mu, kappa, alpha, beta, b0, {_PRED} AS pred FROM bo JOIN (SELECT series, n, t, log_return AS x FROM o) o ON o.series = bo.series AND o.n = bo.n + 1), (SELECT unnest([true, false]) AS grows) WHERE grows OR run = 0))"""


@query(_RUNS + f" SELECT series, t, {r('sum(CASE WHEN run = 0 THEN p END)')} AS change_probability, arg_max(run, p) AS run_length, {r('sum(run * p)', 5)} AS mean_run_length FROM bo WHERE n > 0 GROUP BY 1, 2")
def run_length_posterior(spark: Spark, sf: str) -> DataFrame:
    """Probability of a change, likeliest and mean run length of each bar."""
    out = fold(states(spark, sf), rec.run_lengths, ["log_return"], {"change_probability": "double", "run_length": "long", "mean_run_length": "double", "lost": "double"})
    return rounded(out.withColumn("mean_run_length", F.round("mean_run_length", 5)).drop("lost"))


def marked(threshold: float, least: int = 10) -> str:
    """Bars whose probability of a change is ``threshold`` or more, ``least`` bars after the last such bar."""
    return f""", cp AS (SELECT series, n, t, p FROM bo WHERE run = 0 AND n > 0),
mk AS (SELECT series, 0::BIGINT AS n, 0::BIGINT AS t, 0.0::DOUBLE AS p, -1000000000::BIGINT AS last, false AS change FROM (SELECT DISTINCT series FROM cp)
UNION ALL SELECT cp.series, cp.n, cp.t, cp.p, CASE WHEN cp.p >= {threshold} AND cp.n - mk.last >= {least} THEN cp.n ELSE mk.last END, cp.p >= {threshold} AND cp.n - mk.last >= {least} FROM mk JOIN cp ON cp.series = mk.series AND cp.n = mk.n + 1)"""


@query(_RUNS + marked(0.3) + f" SELECT series, t, {r('p')} AS p, change FROM mk WHERE n > 0")
def change_points(spark: Spark, sf: str) -> DataFrame:
    def run(x):
        p = rec.bocpd(x)
        return {"p": p, "change": rec.change_points(p)}

    return rounded(fold(states(spark, sf), run, ["log_return"], {"p": "double", "change": "boolean"}))


@query(_RUNS + marked(0.05) + """, k AS (SELECT series, t, state AS after, coalesce(lag(state) OVER (PARTITION BY series ORDER BY t), -1) AS before FROM s)
SELECT series, t, before, after, before != after AS changed FROM mk JOIN k USING (series, t) WHERE change""")
def change_alignment(spark: Spark, sf: str) -> DataFrame:
    """States before and after each change point (-1 before the first bar)."""
    return change_alignment_of(states(spark, sf), 0.05)


def change_alignment_of(df: DataFrame, threshold: float) -> DataFrame:
    def run(x, k):
        return {"change": rec.change_points(rec.bocpd(x), threshold, 10), "state": k}

    rows = fold(df, run, ["log_return", "state"], {"change": "boolean", "state": "int"})
    rows = rows.withColumn("before", F.coalesce(F.lag("state").over(order()), F.lit(-1)))
    return rows.where("change").select("series", "t", "before", F.col("state").alias("after"), (F.col("before") != F.col("state")).alias("changed"))


_DUR = STATES + """, d AS (SELECT series, state, avg(length) - 1 AS e, coalesce(var_samp(length), 0) AS v, count(*) AS n_runs FROM runs GROUP BY 1, 2),
q AS (SELECT *, CASE WHEN v > e AND e > 0 THEN (v - e) / v WHEN e > 0 THEN greatest(1 - 1 / greatest(e, 1e-9), 0) ELSE 0.5 END AS p0 FROM d),
z AS (SELECT series, state, n_runs, greatest(least(CASE WHEN v > e AND e > 0 THEN e * (1 - p0) / p0 ELSE 1 END, 50), 0.5) AS r, greatest(least(p0, 0.99), 0.01) AS p FROM q)"""


@query(_DUR + f" SELECT series, state, n_runs, {r('r')} AS r, {r('p')} AS p, {r('r * p / (1 - p) + 1')} AS mean_duration FROM z")
def duration_params(spark: Spark, sf: str) -> DataFrame:
    return rounded(semi_markov.fit_durations(states(spark, sf)))


@query()
def next_state(spark: Spark, sf: str) -> DataFrame:
    def run(x, v, k):
        z = np.c_[x, v]
        p = semi_markov.NextState().fit(z, k).predict(z)[:-1]
        return {"p": [[]] + p.tolist()}

    return fold(states(spark, sf), run, [*_FEATURES, "state"], {"p": "array<double>"})


@query(STATES + """, z AS (SELECT series, k, w, log_return AS x, volatility_w24 AS y FROM e), m AS (SELECT series, k, sum(w) AS sw, sum(w*x)/sum(w) AS mx, sum(w*y)/sum(w) AS my FROM z GROUP BY 1, 2),
c AS (SELECT series, k, sum(w*power(x-mx,2))/any_value(sw) AS a, sum(w*power(y-my,2))/any_value(sw) AS d, sum(w*(x-mx)*(y-my))/any_value(sw) AS b FROM z JOIN m USING (series, k) GROUP BY 1, 2)""" + f" SELECT series, k AS state, {r('((a + d) / 2 + sqrt(power((a - d) / 2, 2) + b * b) + 1e-10) / (a + d + 1e-15)')} AS share_1 FROM c")
def factor_shares(spark: Spark, sf: str) -> DataFrame:
    out = factors.by_series(states(spark, sf), _FEATURES, 1).where("state >= 0 and factor = 0")
    return rounded(out.select("series", "state", F.col("share").alias("share_1")))


# --- the panel of three series in SQL: closed forms of 3 x 3 matrices ---

_R3 = range(3)


def _adjugate(m: str) -> tuple[list[list[str]], str]:
    """Cofactors and determinant of the symmetric matrix of columns m00, m01, ..., m22."""
    c = [[f"{m}{min(i, j)}{max(i, j)}" for j in _R3] for i in _R3]

    def cofactor(i, j):
        (a, b), (x, y) = [k for k in _R3 if k != i], [k for k in _R3 if k != j]
        return f"({'' if (i + j) % 2 == 0 else '-'}({c[a][x]} * {c[b][y]} - {c[a][y]} * {c[b][x]}))"

    adj = [[cofactor(i, j) for j in _R3] for i in _R3]
    return adj, "(" + " + ".join(f"{c[0][j]} * {adj[0][j]}" for j in _R3) + ")"


def _sym(name: str, make) -> str:
    """Columns name00 to name22 of a symmetric matrix."""
    return ", ".join(f"{make(i, j)} AS {name}{i}{j}" for i in _R3 for j in range(i, 3))


def _of(m: str, i: int, j: int) -> str:
    return f"{m}{min(i, j)}{max(i, j)}"


def _simplex(v: str, i: int) -> str:
    """The nearest weight of v0, v1, v2 that is not negative, where all sum to one."""
    u = [f"list_reverse_sort([{v}0, {v}1, {v}2])[{k}]" for k in (1, 2, 3)]
    t = [f"({' + '.join(u[:k])} - 1) / {k}" for k in (1, 2, 3)]
    return f"greatest({v}{i} - CASE WHEN {u[2]} > {t[2]} THEN {t[2]} WHEN {u[1]} > {t[1]} THEN {t[1]} ELSE {t[0]} END, 0)"


_ADJ, _DET = _adjugate("c")
_ASSETS = ["F", "O", "P"]
_PM = PANEL + f""", pl AS (SELECT *, lag(ret) OVER (PARTITION BY series ORDER BY t) AS back FROM pn),
wd AS (SELECT * FROM (SELECT t, {", ".join(f"max(ret) FILTER (series = '{a}') AS r{i}, max(back) FILTER (series = '{a}') AS l{i}" for i, a in enumerate(_ASSETS))} FROM pl GROUP BY 1) WHERE {" AND ".join(f"r{i} IS NOT NULL AND l{i} IS NOT NULL" for i in _R3)}),
wx AS (SELECT *, {", ".join(f"exp(-0.5 * power(((0.0 + r0 + r1 + r2) / 3 * 100 - ({c})) / {SD}, 2)) AS g{k}" for k, c in enumerate(CENTRES))} FROM wd),
wk AS (SELECT t, r0, r1, r2, l0, l1, l2, unnest([0, 1, 2, -1]) AS state, unnest([g0 / (g0 + g1 + g2), g1 / (g0 + g1 + g2), g2 / (g0 + g1 + g2), 1.0]) AS w FROM wx),
mu AS (SELECT state, sum(w) AS sw, {", ".join(f"sum(w * r{i}) / sum(w) AS m{i}, sum(w * l{i}) / sum(w) AS k{i}" for i in _R3)} FROM wk GROUP BY 1),
cv AS (SELECT state, any_value(sw) AS sw, {", ".join(f"any_value(m{i}) AS m{i}" for i in _R3)}, {_sym("c", lambda i, j: f"sum(w * (r{i} - m{i}) * (r{j} - m{j})) / any_value(sw)" + (" + 1e-6" if i == j else ""))},
{_sym("x", lambda i, j: f"sum(w * (l{i} - k{i}) * (l{j} - k{j})) / any_value(sw)")}, {", ".join(f"sum(w * (l{i} - k{i}) * (r{j} - m{j})) / any_value(sw) AS y{i}{j}" for i in _R3 for j in _R3)} FROM wk JOIN mu USING (state) GROUP BY 1),
a1 AS (SELECT *, {", ".join("(" + " + ".join(_ADJ[i]) + f") / {_DET} AS a{i}" for i in _R3)}, {", ".join("(" + " + ".join(f"{_ADJ[i][j]} * m{j}" for j in _R3) + f") / {_DET} AS b{i}" for i in _R3)} FROM cv),
a2 AS (SELECT *, {", ".join(f"a{i} / (a0 + a1 + a2) AS p{i}, CASE WHEN b0 + b1 + b2 > 1e-12 THEN b{i} / (b0 + b1 + b2) ELSE a{i} / (a0 + a1 + a2) END AS q{i}" for i in _R3)} FROM a1),
mv AS (SELECT *, {", ".join(f"{_simplex('p', i)} AS u{i}, {_simplex('q', i)} AS v{i}" for i in _R3)} FROM a2)"""
_ASSET_ROWS = f"(SELECT unnest({_ASSETS}) AS asset, unnest([1, 2, 3]) AS i)"
_POSTERIOR, _POSTERIOR_DET = _adjugate("h")
_PRIOR, _PRIOR_DET = _adjugate("n")
_BL = _PM + f""", tn AS (SELECT state, m0, m1, m2, {_sym("n", lambda i, j: f"0.05 * c{i}{j}" + (" + 1e-10" if i == j else ""))}, (SELECT 0.8 * max(w) FROM wk WHERE state >= 0 AND t = (SELECT max(t) FROM wk)) AS sure FROM cv),
tc AS (SELECT state, m0, m1, m2, sure, {_sym("g", lambda i, j: f"{_PRIOR[i][j]} / {_PRIOR_DET}")} FROM tn),
th AS (SELECT *, {_sym("h", lambda i, j: f"g{i}{j}" + (" + sure" if i == j else ""))}, {", ".join(" + ".join(f"{_of('g', i, j)} * m{j}" for j in _R3) + f" + sure * 5e-4 AS e{i}" for i in _R3)} FROM tc),
bl AS (SELECT state, [{", ".join("(" + " + ".join(f"{_POSTERIOR[i][j]} * e{j}" for j in _R3) + f") / {_POSTERIOR_DET}" for i in _R3)}] AS x FROM th)"""
_RIDGED, _RIDGED_DET = _adjugate("z")
_VAR = _PM + f""", vr AS (SELECT *, {_sym("z", lambda i, j: f"x{i}{j}" + (" + 1e-6 / sw" if i == j else ""))} FROM cv),
vb AS (SELECT *, {", ".join("(" + " + ".join(f"{_RIDGED[j][k]} * y{k}{i}" for k in _R3) + f") / {_RIDGED_DET} AS f{i}{j}" for i in _R3 for j in _R3)} FROM vr),
vs AS (SELECT *, {_sym("s", lambda i, j: f"c{i}{j}" + (" - 1e-6" if i == j else "") + "".join(f" - f{i}{k} * y{k}{j} - y{k}{i} * f{j}{k}" for k in _R3) + "".join(f" + f{i}{k} * {_of('x', k, n)} * f{j}{n}" for k in _R3 for n in _R3))} FROM vb),
vl AS (SELECT *, sqrt(s00) AS t00, s01 / sqrt(s00) AS t10, s02 / sqrt(s00) AS t20, sqrt(s11 - s01 * s01 / s00) AS t11, (s12 - s01 * s02 / s00) / sqrt(s11 - s01 * s01 / s00) AS t21,
sqrt(s22 - s02 * s02 / s00 - power((s12 - s01 * s02 / s00) / sqrt(s11 - s01 * s01 / s00), 2)) AS t22 FROM vs),
ir AS (SELECT state, {", ".join(f"f{i}{j}" for i in _R3 for j in _R3)}, shock, 0 AS horizon, [t00, 0.0, 0.0][shock] AS e0, [t10, t11, 0.0][shock] AS e1, [t20, t21, t22][shock] AS e2 FROM vl, (SELECT unnest([1, 2, 3]) AS shock)
UNION ALL SELECT state, {", ".join(f"f{i}{j}" for i in _R3 for j in _R3)}, shock, horizon + 1, {", ".join(" + ".join(f"f{i}{j} * e{j}" for j in _R3) for i in _R3)} FROM ir WHERE horizon < 10)"""


def _wide(spark: Spark, sf: str) -> tuple[DataFrame, list[str]]:
    return side_by_side.side_by_side(panel(spark, sf), CENTRES, SD)


@query(_VAR + f" SELECT state, {_ASSETS}[shock] AS shock, horizon::INT AS horizon, asset AS response_of, {r('[e0, e1, e2][i]')} AS response FROM ir, {_ASSET_ROWS}")
def regime_var(spark: Spark, sf: str) -> DataFrame:
    """Impulse responses of each state's vector autoregression of the panel's returns; -1 is all bars."""
    return rounded(side_by_side.impulse_responses(*_wide(spark, sf)))


@query(_VAR + f" SELECT state, {_ASSETS}[j] AS cause, asset AS effect, {r('abs([[f00, f01, f02], [f10, f11, f12], [f20, f21, f22]][i][j])')} AS strength FROM vb, {_ASSET_ROWS}, (SELECT unnest([1, 2, 3]) AS j)")
def granger_table(spark: Spark, sf: str) -> DataFrame:
    """How much each series' past moves each other, by state."""
    return rounded(side_by_side.granger(*_wide(spark, sf)))


@query(_PM + f" SELECT state, asset, {r('[u0, u1, u2][i]')} AS min_variance, {r('[v0, v1, v2][i]')} AS max_sharpe FROM mv, {_ASSET_ROWS}")
def mean_variance(spark: Spark, sf: str) -> DataFrame:
    """Weights of least variance and of the best ratio, by state and for all bars (-1)."""
    return rounded(side_by_side.mean_variance(*_wide(spark, sf)))


@query(_PM + f" SELECT t, asset, {r('sum(w * round([v0, v1, v2][i], 6)) / sum(w)')} AS weight FROM wk JOIN mv USING (state), {_ASSET_ROWS} WHERE state >= 0 GROUP BY 1, 2")
def blended_mean_variance(spark: Spark, sf: str) -> DataFrame:
    """The states' best weights mixed by each bar's posterior."""
    rows, names = _wide(spark, sf)
    return rounded(side_by_side.blended(rows, rounded(side_by_side.mean_variance(rows, names))))


@query(_PM + f", fr AS (SELECT *, unnest(range(30))::INT AS point FROM mv), fw AS (SELECT *, {', '.join(f'(1 - point / 29.0) * u{i} + point / 29.0 * v{i} AS o{i}' for i in _R3)} FROM fr) SELECT state, point, {r('sqrt(' + ' + '.join(f'o{i} * o{j} * ' + _of('c', i, j) for i in _R3 for j in _R3) + ')')} AS volatility, {r('o0 * m0 + o1 * m1 + o2 * m2')} AS mean, {r('(o0 * m0 + o1 * m1 + o2 * m2) / sqrt(' + ' + '.join(f'o{i} * o{j} * ' + _of('c', i, j) for i in _R3 for j in _R3) + ')')} AS sharpe FROM fw")
def efficient_frontier(spark: Spark, sf: str) -> DataFrame:
    """Volatility, return and ratio of mixes between the two portfolios of each state."""
    return rounded(side_by_side.frontier(*_wide(spark, sf)).drop("weights"))


@query(_BL + f" SELECT state, asset, {r('x[i]', 9)} AS posterior_mean FROM bl, {_ASSET_ROWS}")
def black_litterman(spark: Spark, sf: str) -> DataFrame:
    """Each state's means drawn toward the view that all earn 0.0005, as surely as the last bar's state."""
    rows, names = _wide(spark, sf)
    last = rows.where("state >= 0").groupBy("t").agg(F.array_sort(F.collect_list(F.struct("state", "w"))).alias("p")).orderBy(F.desc("t")).first()
    return rounded(side_by_side.black_litterman(rows, names, dict.fromkeys(names, 5e-4), 0.8, [x.w for x in last.p] if last else None, 0.05), 9)


_LIVE = _FILTER + f""", lb AS (SELECT fl.series, fl.n, fl.t, CASE WHEN a0 >= a1 AND a0 >= a2 THEN 0 WHEN a1 >= a2 THEN 1 ELSE 2 END AS k, exp(greatest(a0, a1, a2)) AS conf, close FROM fl JOIN s ON s.series = fl.series AND s.t = fl.t WHERE n > 0),
lv AS (SELECT series, 0::BIGINT AS n, 0::BIGINT AS t, -1 AS prev, 0.0::DOUBLE AS conf, 0 AS since, false AS fired, false AS alert, -1.0::DOUBLE AS held, 100000.0::DOUBLE AS cash, 0.0::DOUBLE AS pos, 0.0::DOUBLE AS average, 0.0::DOUBLE AS realized, 0.0::DOUBLE AS close, 0 AS k FROM (SELECT DISTINCT series FROM lb)
UNION ALL SELECT series, n, t, CASE WHEN n > 10 THEN k ELSE prev END, conf, CASE WHEN hit THEN 0 WHEN n > 10 THEN since + 1 ELSE since END, fired OR hit, hit, CASE WHEN n > 10 THEN w ELSE held END, cash - change * fill,
CASE WHEN abs(pos + change) < 1e-12 THEN 0.0 ELSE pos + change END, CASE WHEN abs(pos + change) < 1e-12 THEN 0.0 WHEN change > 0 THEN (pos * average + change * fill) / (pos + change) ELSE average END,
realized + CASE WHEN change < 0 THEN least(-change, pos) * (fill - average) ELSE 0.0 END, close, k FROM (
SELECT *, close * CASE WHEN change > 0 THEN 1.0005 ELSE 0.9995 END AS fill FROM (SELECT *, CASE WHEN abs(raw) < 1e-10 THEN 0.0 ELSE raw END AS change FROM (
SELECT *, CASE WHEN n > 10 AND (held < 0 OR abs(w - held) > 0.01) THEN (cash + pos * close) * w / close - pos ELSE 0.0 END AS raw FROM (
SELECT lb.series, lb.n, lb.t, lb.k, lb.conf, lb.close, lv.prev, lv.since, lv.fired, lv.held, lv.cash, lv.pos, lv.average, lv.realized, CASE lb.k WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS w,
lb.n > 10 AND lv.prev >= 0 AND lb.k != lv.prev AND lb.conf >= 0.6 AND (NOT lv.fired OR lv.since + 1 > 3) AS hit FROM lv JOIN lb ON lb.series = lv.series AND lb.n = lv.n + 1)))))"""


@query(_LIVE + f" SELECT series, t, k AS state, {r('conf')} AS confidence, alert, {r('pos', 4)} AS position, {r('cash + pos * close', 4)} AS equity, {r('realized', 4)} AS realized FROM lv WHERE n > 0")
def live_replay(spark: Spark, sf: str) -> DataFrame:
    config = Live(tuple(START), tuple(map(tuple, TRANS)), tuple(MEANS), tuple(SDS), {0: 0.0, 1: 0.5, 2: 1.0}, warmup=10)
    rows = replay(states(spark, sf), config)
    return rounded(rows.withColumns({c: F.round(c, 4) for c in ("position", "equity", "realized")}))


