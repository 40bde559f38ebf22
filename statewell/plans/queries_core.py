"""Bars, features, states, statistics, signals and backtests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fold import fold
from ..functions.posterior import argmax, entropy
from ..functions.rolling import so_far, drawdown
from ..operators import performance as perf
from ..operators import recursions as rec
from ..operators import scan
from ..operators import states as st
from ..operators.features import log_returns, log_volume, rolling_volatility, smoothed_returns, volume_zscore
from ..sources import bars
from .base import BARS, FEATURES, STATES, feature_frame, query, r, rounded, states

Spark = SparkSession


@query("WITH " + BARS + " SELECT series, t, open, high, low, close, volume FROM bars")
def bars_hourly(spark: Spark, sf: str) -> DataFrame:
    return bars.hourly_by_type(spark, sf).select("series", "t", "open", "high", "low", "close", "volume")


@query("WITH " + FEATURES + f" SELECT series, t, {r('log_return')} AS log_return FROM f0")
def log_return(spark: Spark, sf: str) -> DataFrame:
    return rounded(bars.hourly_by_type(spark, sf).transform(log_returns()).select("series", "t", "log_return"))


@query("WITH " + FEATURES + f" SELECT series, t, {r('smoothed_return_w12')} AS smoothed_return_w12 FROM f1", "smoothed_returns")
def smoothed(spark: Spark, sf: str) -> DataFrame:
    df = bars.hourly_by_type(spark, sf).transform(log_returns()).transform(smoothed_returns(12))
    return rounded(df.select("series", "t", "smoothed_return_w12"))


@query("WITH " + FEATURES + f" SELECT series, t, {r('volatility_w24')} AS volatility_w24 FROM f1", "rolling_volatility")
def volatility(spark: Spark, sf: str) -> DataFrame:
    df = bars.hourly_by_type(spark, sf).transform(log_returns()).transform(rolling_volatility(24))
    return rounded(df.select("series", "t", "volatility_w24"))


@query("WITH " + FEATURES + f" SELECT series, t, {r('log_volume')} AS log_volume FROM f0", "log_volume")
def volume(spark: Spark, sf: str) -> DataFrame:
    return rounded(bars.hourly_by_type(spark, sf).transform(log_volume()).select("series", "t", "log_volume"))


@query("WITH " + FEATURES + f" SELECT series, t, {r('volume_zscore_w24')} AS volume_zscore_w24 FROM f1", "volume_zscore")
def volume_z(spark: Spark, sf: str) -> DataFrame:
    df = bars.hourly_by_type(spark, sf).transform(log_volume()).transform(volume_zscore(24))
    return rounded(df.select("series", "t", "volume_zscore_w24"))


@query("WITH " + FEATURES + f" SELECT series, t, {r('log_return')} AS log_return, {r('volatility_w24')} AS volatility_w24, {r('smoothed_return_w12')} AS smoothed_return_w12, {r('volume_zscore_w24')} AS volume_zscore_w24, {r('log_hl_range')} AS log_hl_range FROM features")
def feature_pipeline(spark: Spark, sf: str) -> DataFrame:
    return rounded(feature_frame(spark, sf).select("series", "t", "log_return", "volatility_w24", "smoothed_return_w12", "volume_zscore_w24", "log_hl_range"))


@query(STATES + f"SELECT series, t, state, {r('p0')} AS p0, {r('p1')} AS p1, {r('p2')} AS p2, {r('-(p0*ln(greatest(p0,1e-15))+p1*ln(greatest(p1,1e-15))+p2*ln(greatest(p2,1e-15)))')} AS entropy FROM s")
def state_posteriors(spark: Spark, sf: str) -> DataFrame:
    p = F.col("posterior")
    return rounded(states(spark, sf).select("series", "t", "state", p[0].alias("p0"), p[1].alias("p1"), p[2].alias("p2"), entropy(p).alias("entropy")))


@query(STATES + f"SELECT series, state, {r('avg(length)')} AS mean_dwell, {r('quantile_cont(length, 0.5)')} AS median_dwell, max(length) AS max_dwell, count(*) AS n_runs FROM runs GROUP BY 1, 2")
def dwell_times(spark: Spark, sf: str) -> DataFrame:
    return rounded(st.dwell_times(states(spark, sf)))


@query(STATES + "SELECT series, t, state, row_number() OVER (PARTITION BY series, run ORDER BY t) AS run_length FROM runs0")
def run_lengths(spark: Spark, sf: str) -> DataFrame:
    return st.run_lengths(states(spark, sf)).select("series", "t", "state", F.col("run_length").cast("long"))


@query(STATES + ", last AS (SELECT series, max(t) AS last FROM s GROUP BY 1) SELECT series, run, state, start, coalesce(lead(start) OVER (PARTITION BY series ORDER BY run), last) AS \"end\", length FROM runs JOIN last USING (series)")
def state_spans(spark: Spark, sf: str) -> DataFrame:
    return st.runs(states(spark, sf)).select("series", "run", "state", "start", "end", "length")


@query(STATES + f""", n AS (SELECT series, state, nxt AS "to", count(*) AS n FROM (SELECT series, state, lead(state) OVER (PARTITION BY series ORDER BY t) AS nxt FROM s) WHERE nxt IS NOT NULL GROUP BY 1, 2, 3)
SELECT series, state, "to", {r('n / sum(n) OVER (PARTITION BY series, state)')} AS p FROM n""")
def transition_matrix_empirical(spark: Spark, sf: str) -> DataFrame:
    return rounded(st.transition_matrix(states(spark, sf)))


@query(STATES + f""", n AS (SELECT series, state, nxt, count(*) AS n FROM (SELECT series, state, lead(state) OVER (PARTITION BY series ORDER BY t) AS nxt FROM s) WHERE nxt IS NOT NULL GROUP BY 1, 2, 3),
p AS (SELECT series, state, n / sum(n) OVER (PARTITION BY series, state) AS p FROM n)
SELECT series, state, {r('-sum(p * ln(p))')} AS entropy FROM p GROUP BY 1, 2""")
def transition_entropy(spark: Spark, sf: str) -> DataFrame:
    p = st.transition_matrix(states(spark, sf))
    return rounded(p.groupBy("series", "state").agg((-F.sum(F.col("p") * F.ln("p"))).alias("entropy")))


#: A fixed model: start, transitions, means and deviations of log returns.
START, TRANS = np.array([0.5, 0.3, 0.2]), np.array([[0.7, 0.2, 0.1], [0.25, 0.5, 0.25], [0.1, 0.3, 0.6]])
MEANS, SDS = np.array([-1.5, 0.0, 1.5]), np.array([1.2, 0.8, 1.2])


_STATS = STATES + """, m AS (
    SELECT series, state, count(*) AS n, avg(ret) AS mean, coalesce(stddev_samp(ret), 0) AS sd, stddev_pop(ret) AS sp, quantile_cont(ret, 0.05) AS q,
           avg((ret > 0)::INT) AS win_rate, kurtosis_pop(ret) AS kurt FROM s GROUP BY 1, 2
), sk AS (SELECT s.series, s.state, avg(power(ret - mean, 3)) / power(any_value(sp), 3) AS skew, avg(CASE WHEN ret <= q THEN ret END) AS cvar FROM s JOIN m USING (series, state) GROUP BY 1, 2),
lv AS (SELECT *, exp(sum(ret) OVER (PARTITION BY series, run ORDER BY t)) AS level FROM runs0),
dd AS (SELECT series, state, max(1 - level / top) AS mdd FROM (SELECT *, max(level) OVER (PARTITION BY series, run ORDER BY t) AS top FROM lv) GROUP BY 1, 2),
st AS (SELECT series, state, n, n / sum(n) OVER (PARTITION BY series) AS weight, mean * 8760 AS mean_return_ann, sd * sqrt(8760) AS vol_ann,
       CASE WHEN sd * sqrt(8760) > 1e-12 THEN mean * 8760 / (sd * sqrt(8760)) END AS sharpe_ann, CASE WHEN n >= 3 THEN skew END AS skewness,
       CASE WHEN n >= 4 THEN kurt END AS excess_kurtosis, mdd AS max_drawdown, q AS var_95, cvar AS cvar_95, win_rate
       FROM m JOIN sk USING (series, state) JOIN dd USING (series, state))
"""
_STAT_COLUMNS = ["weight", "mean_return_ann", "vol_ann", "sharpe_ann", "skewness", "excess_kurtosis", "max_drawdown", "var_95", "cvar_95", "win_rate"]


@query(_STATS + "SELECT series, state, n, " + ", ".join(f"{r(c)} AS {c}" for c in _STAT_COLUMNS) + " FROM st")
def regime_stats(spark: Spark, sf: str) -> DataFrame:
    return rounded(perf.state_stats(states(spark, sf)))


@query(_STATS + f"SELECT series, state, {r('max_drawdown')} AS max_drawdown FROM st")
def per_run_mdd(spark: Spark, sf: str) -> DataFrame:
    return rounded(st.run_drawdown(states(spark, sf), "ret"))


_SCORES = _STATS + """, sc AS (SELECT series, state, CASE WHEN count(*) OVER (PARTITION BY series) > 1 THEN 2.0 * (row_number() OVER (PARTITION BY series ORDER BY v, state) - 1) / (count(*) OVER (PARTITION BY series) - 1) - 1 ELSE 0.0 END AS score
    FROM (SELECT series, state, coalesce(sharpe_ann, median(sharpe_ann) OVER (PARTITION BY series)) AS v FROM st)),
sg AS (SELECT s.series, t, ret, close, state, p0, p1, p2, greatest(-1.0, least(1.0, p0 * c0 + p1 * c1 + p2 * c2)) AS signal FROM s JOIN (
    SELECT series, sum(CASE WHEN state = 0 THEN score END) AS c0, sum(CASE WHEN state = 1 THEN score END) AS c1, sum(CASE WHEN state = 2 THEN score END) AS c2 FROM sc GROUP BY 1) USING (series))
"""


@query(_SCORES + f"SELECT series, state, {r('score')} AS score FROM sc")
def score_states(spark: Spark, sf: str) -> DataFrame:
    return rounded(perf.scores(perf.state_stats(states(spark, sf))))


@query(_STATS + f"""SELECT series, state, {r('2.0 * (rank() OVER (PARTITION BY series ORDER BY v) + (count(*) OVER (PARTITION BY series, v) - 1) / 2.0 - 1) / (count(*) OVER (PARTITION BY series) - 1) - 1')} AS score
FROM (SELECT series, state, coalesce(sharpe_ann, 0.0) AS v FROM st)""")
def score_states_average_rank(spark: Spark, sf: str) -> DataFrame:
    return rounded(perf.average_rank_scores(perf.state_stats(states(spark, sf))))


def signals(spark: Spark, sf: str) -> DataFrame:
    df = states(spark, sf)
    return perf.posterior_signal(df, perf.scores(perf.state_stats(df)))


@query(_SCORES + f"SELECT series, t, {r('signal')} AS signal FROM sg")
def posterior_signal(spark: Spark, sf: str) -> DataFrame:
    return rounded(signals(spark, sf).select("series", "t", "signal"))


@query(_SCORES + f""", o AS (SELECT series, t, signal, row_number() OVER (PARTITION BY series ORDER BY t) AS n FROM sg),
em AS (SELECT series, t, n, signal AS y FROM o WHERE n = 1 UNION ALL SELECT o.series, o.t, o.n, 2.0 / 13 * o.signal + (1 - 2.0 / 13) * em.y FROM em JOIN o ON o.series = em.series AND o.n = em.n + 1)
SELECT series, t, {r('y')} AS signal_ema FROM em""")
def signal_ema(spark: Spark, sf: str) -> DataFrame:
    out = fold(signals(spark, sf), lambda x: {"signal_ema": rec.ema(x, 2 / 13)}, ["signal"], {"signal_ema": "double"})
    return rounded(out)


_BT = """, po AS (SELECT *, {position} AS position FROM sg),
ne AS (SELECT *, coalesce(lag(position) OVER w, 0) * ret AS gross, coalesce(lag(position) OVER w, 0) * ret - coalesce(abs(position - lag(position) OVER w), 0) * 1.0 / 1e4 AS net FROM po WINDOW w AS (PARTITION BY series ORDER BY t)),
eq AS (SELECT *, 10000.0 * exp(sum(ln(1 + net)) OVER (PARTITION BY series ORDER BY t)) AS equity FROM ne)
"""
_POSITIONS = {
    "proportional": "greatest(-1.0, least(1.0, signal))",
    "threshold": "CASE WHEN signal > 0.25 THEN 1.0 WHEN signal < -0.25 THEN -1.0 ELSE 0.0 END",
    "long_only": "greatest(0.0, least(1.0, signal))",
}


def _backtest(mode: str):
    def run(spark: Spark, sf: str) -> DataFrame:
        out = perf.backtest(signals(spark, sf), config=perf.Backtest(mode=mode))
        return rounded(out.select("series", "t", "position", "gross", "net", "equity"))

    sql = _SCORES + _BT.format(position=_POSITIONS[mode]) + f"SELECT series, t, {r('position')} AS position, {r('gross')} AS gross, {r('net')} AS net, {r('equity')} AS equity FROM eq"
    query(sql, f"backtest_{mode}")(run)


for _mode in _POSITIONS:
    _backtest(_mode)


@query(_SCORES + _BT.format(position=_POSITIONS["proportional"]) + f""", x AS (SELECT *, (max(equity) OVER w - equity) / max(equity) OVER w AS dd, (position != lag(position) OVER w)::INT AS moved FROM eq WINDOW w AS (PARTITION BY series ORDER BY t)),
y AS (SELECT series, count(*) AS n, arg_min(equity, t) AS e0, arg_max(equity, t) AS e1, avg(net) AS mean, stddev_samp(net) AS sd, max(dd) AS mdd, avg(CASE WHEN net != 0 THEN (net > 0)::INT END) AS hit,
      sum(CASE WHEN net > 0 THEN net ELSE 0 END) AS up, sum(CASE WHEN net < 0 THEN net ELSE 0 END) AS down, coalesce(sum(moved), 0)::BIGINT AS trades FROM x GROUP BY 1),
z AS (SELECT *, e1 / e0 - 1 AS total, power(e1 / e0, 8760.0 / n) - 1 AS cagr FROM y)
SELECT series, {r('total')} AS total_return, {r('cagr', 4)} AS cagr, {r('mean / sd * sqrt(8760)')} AS sharpe_ann, {r('mdd')} AS max_drawdown, {r('cagr / mdd', 3)} AS calmar, {r('hit')} AS hit_rate,
{r('up / abs(down)')} AS profit_factor, trades AS n_trades, {r('total / trades', 9)} AS avg_return_per_trade FROM z""")
def backtest_metrics(spark: Spark, sf: str) -> DataFrame:
    m = perf.backtest_metrics(perf.backtest(signals(spark, sf)))
    return rounded(m.withColumn("cagr", F.round("cagr", 4)).withColumn("calmar", F.round("calmar", 3)), 9).select(
        "series", *[(F.round(c, 6) + 0.0).alias(c) for c in ("total_return",)], "cagr", *[(F.round(c, 6) + 0.0).alias(c) for c in ("sharpe_ann", "max_drawdown")], "calmar", *[(F.round(c, 6) + 0.0).alias(c) for c in ("hit_rate", "profit_factor")], "n_trades", "avg_return_per_trade"
    )


@query(STATES + f"""SELECT series, state, n_bars, {r('total_return')} AS total_return, {r('ann_vol')} AS ann_vol, {r('sharpe')} AS sharpe, {r('win_rate')} AS win_rate FROM (
SELECT series, state, count(*) AS n_bars, exp(sum(ret)) - 1 AS total_return, stddev_samp(ret) * sqrt(252) AS ann_vol, avg(ret) / (stddev_samp(ret) + 1e-15) * sqrt(252) AS sharpe, avg((ret > 0)::INT) AS win_rate FROM s GROUP BY GROUPING SETS ((series, state), (series)))""")
def performance_attribution(spark: Spark, sf: str) -> DataFrame:
    return rounded(perf.attribution(states(spark, sf)))


_RISK = STATES + """, lv AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY series, state ORDER BY t)) AS level FROM s),
dd AS (SELECT *, (max(level) OVER w - level) / max(level) OVER w AS dd FROM lv WINDOW w AS (PARTITION BY series, state ORDER BY t)),
b AS (SELECT series, state, count(*) AS n, avg(ret) AS mean, stddev_samp(ret) AS sd, quantile_cont(ret, 0.05) AS q, sqrt(avg(power(least(ret, 0), 2))) AS down, max(dd) AS mdd FROM dd GROUP BY 1, 2),
c AS (SELECT s.series, s.state, -avg(ret) AS cvar FROM s JOIN b USING (series, state) WHERE ret <= q GROUP BY 1, 2),
k AS (SELECT series, state, n, mean * 8760 AS mean_ann, sd * sqrt(8760) AS vol_ann, mean * 8760 / (sd * sqrt(8760)) AS sharpe, CASE WHEN down >= 1e-12 THEN mean / down * sqrt(8760) END AS sortino, -q AS var, cvar, mdd AS max_drawdown,
      CASE WHEN mdd > 1e-12 THEN mean * 8760 / mdd END AS calmar FROM b JOIN c USING (series, state))
"""
_RISK_COLUMNS = ["mean_ann", "vol_ann", "sharpe", "sortino", "var", "cvar", "max_drawdown", "calmar"]


@query(_RISK + "SELECT series, state, n, " + ", ".join(f"CASE WHEN n >= 20 THEN {r(c)} END AS {c}" for c in _RISK_COLUMNS) + " FROM k")
def regime_risk_hard(spark: Spark, sf: str) -> DataFrame:
    return rounded(perf.risk_by_state(states(spark, sf)))


@query(_RISK + ", u AS (UNPIVOT (SELECT series, state, CASE WHEN n >= 20 THEN mean_ann END AS mean_ann, CASE WHEN n >= 20 THEN vol_ann END AS vol_ann, CASE WHEN n >= 20 THEN sharpe END AS sharpe, CASE WHEN n >= 20 THEN var END AS var, CASE WHEN n >= 20 THEN max_drawdown END AS max_drawdown FROM k) ON mean_ann, vol_ann, sharpe, var, max_drawdown INTO NAME metric VALUE value) " + f"SELECT a.series, a.state AS state_a, b.state AS state_b, a.metric, {r('abs(a.value - b.value)')} AS diff FROM u a JOIN u b ON a.series = b.series AND a.metric = b.metric AND a.state < b.state")
def risk_divergence(spark: Spark, sf: str) -> DataFrame:
    return rounded(perf.divergence(perf.risk_by_state(states(spark, sf))))


_WQ = """, c AS (SELECT series, k, {x} AS x, t, sum(w) OVER (PARTITION BY series, k ORDER BY {x}, t) / sum(w) OVER (PARTITION BY series, k) AS share, w FROM e)"""


@query(STATES + _WQ.format(x="ret") + f"SELECT series, k AS state, {r('min(x)')} AS quantile FROM c WHERE share >= 0.05 GROUP BY 1, 2")
def weighted_quantile(spark: Spark, sf: str) -> DataFrame:
    rows = perf.exploded(states(spark, sf), "ret")
    return rounded(perf.weighted_quantile(rows, "ret", 0.05, ["series", "k"]).withColumnRenamed("k", "state"))


_HARD = """, lv AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY series, state ORDER BY t)) AS level FROM s), dd AS (SELECT series, state, ret, (max(level) OVER w - level) / max(level) OVER w AS dd FROM lv WINDOW w AS (PARTITION BY series, state ORDER BY t)),
hd AS (SELECT series, state AS k, CASE WHEN count(*) >= 20 THEN max(dd) END AS mdd, CASE WHEN count(*) >= 20 AND max(dd) > 1e-12 THEN avg(ret) * 8760 / max(dd) END AS calmar FROM dd GROUP BY 1, 2)"""


@query(STATES + _WQ.format(x="ret") + _HARD + f""", q AS (SELECT series, k, min(x) AS q FROM c WHERE share >= 0.05 GROUP BY 1, 2), m AS (SELECT series, k, sum(w) AS n, sum(w * ret) / sum(w) AS mean FROM e GROUP BY 1, 2),
v AS (SELECT e.series, e.k, sum(w * power(ret - mean, 2)) / sum(w) AS v, sqrt(sum(w * power(least(ret, 0), 2)) / sum(w)) AS down FROM e JOIN m USING (series, k) GROUP BY 1, 2), cv AS (SELECT e.series, e.k, -sum(w * ret) / sum(w) AS cvar FROM e JOIN q USING (series, k) WHERE ret <= q GROUP BY 1, 2)
SELECT series, k AS state, {r('n')} AS eff_n, """ + ", ".join(f"CASE WHEN n >= 20 THEN {r(x)} END AS {y}" for x, y in (("mean * 8760", "mean_ann"), ("sqrt(v) * sqrt(8760)", "vol_ann"), ("mean * 8760 / (sqrt(v) * sqrt(8760))", "sharpe"), ("CASE WHEN down > 1e-12 THEN mean / down * sqrt(8760) END", "sortino"), ("-q", "var"), ("cvar", "cvar"), ("mdd", "max_drawdown"), ("calmar", "calmar"))) + """
FROM m JOIN v USING (series, k) JOIN q USING (series, k) JOIN cv USING (series, k) LEFT JOIN hd USING (series, k)""")
def regime_risk_weighted(spark: Spark, sf: str) -> DataFrame:
    return rounded(perf.weighted_risk(states(spark, sf)))


@query(STATES + f"SELECT series, t, {r('(level - top) / (top + 1e-15)')} AS drawdown FROM (SELECT series, t, level, max(level) OVER (PARTITION BY series ORDER BY t) AS top FROM (SELECT series, t, exp(sum(ret) OVER (PARTITION BY series ORDER BY t)) AS level FROM s))")
def running_drawdown(spark: Spark, sf: str) -> DataFrame:
    df = states(spark, sf).withColumn("level", F.exp(F.sum("ret").over(so_far())))
    return rounded(df.select("series", "t", drawdown(F.col("level")).alias("drawdown")))


_TAIL = STATES + """, l AS (SELECT series, t, k, w, -ret AS loss FROM e UNION ALL SELECT series, t, -1, 1.0 / count(*) OVER (PARTITION BY series), -ret FROM s),
c AS (SELECT *, sum(w) OVER (PARTITION BY series, k ORDER BY loss, t) / sum(w) OVER (PARTITION BY series, k) AS share, sum(w) OVER (PARTITION BY series, k ORDER BY loss DESC, t) AS upto, sum(w) OVER (PARTITION BY series, k) AS total FROM l),
u AS (SELECT series, k, min(loss) AS u FROM c WHERE share >= 0.9 GROUP BY 1, 2), n AS (SELECT series, k, sum(w) AS n FROM l GROUP BY 1, 2),
ve AS (SELECT series, k, max(loss) AS ve FROM c WHERE upto >= 0.01 * total - 1e-12 GROUP BY 1, 2), ee AS (SELECT l.series, l.k, sum(w * loss) / (sum(w) + 1e-15) AS ee FROM l JOIN ve USING (series, k) WHERE loss >= ve GROUP BY 1, 2),
x AS (SELECT l.series, l.k, avg(loss - u) AS m, var_pop(loss - u) AS v, count(*) AS ne, sum(w) AS we FROM l JOIN u USING (series, k) WHERE loss > u GROUP BY 1, 2),
y AS (SELECT *, CASE WHEN ne >= 10 AND we >= 10 AND v >= 1e-15 AND m >= 1e-15 THEN 0.5 * (1 - m * m / v) END AS x0 FROM x),
g AS (SELECT *, CASE WHEN x0 IS NOT NULL THEN greatest(m * (1 - x0), 1e-10) END AS sigma, CASE WHEN x0 IS NOT NULL THEN greatest(-0.5, least(2.0, x0)) END AS xi FROM y),
z AS (SELECT u.series, u.k, u, n, coalesce(ne, 0) AS ne, xi, sigma, ve, ee, 0.01 * floor(n) / nullif(floor(we), 0) AS rho FROM u JOIN n USING (series, k) JOIN ve USING (series, k) JOIN ee USING (series, k) LEFT JOIN g USING (series, k)),
gz AS (SELECT *, u + CASE WHEN abs(xi) < 1e-6 THEN -sigma * ln(rho) ELSE sigma / xi * (power(rho, -xi) - 1) END AS gpd FROM z),
gv AS (SELECT *, coalesce(gpd, ve) AS var, coalesce(CASE WHEN xi < 1 THEN (gpd + sigma - xi * u) / (1 - xi) END, ee) AS es FROM gz)
"""


@query(_TAIL + f"SELECT series, k AS state, {r('u')} AS threshold, {r('n')} AS eff_n, ne AS n_exc, {r('xi')} AS xi, {r('sigma')} AS sigma, {r('var')} AS var, {r('es')} AS es, gpd IS NOT NULL AS fitted FROM gv")
def gpd_tail(spark: Spark, sf: str) -> DataFrame:
    return rounded(perf.tails(states(spark, sf)))


@query(_TAIL + f""", d AS (SELECT series, k, var, es FROM gv), last AS (SELECT series, arg_max(p0, t) AS p0, arg_max(p1, t) AS p1, arg_max(p2, t) AS p2 FROM s GROUP BY 1)
SELECT series, k AS state, {r('CASE k WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END')} AS weight, {r('CASE k WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END * var')} AS var_part, {r('CASE k WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END * es')} AS es_part FROM d JOIN last USING (series) WHERE k >= 0""")
def tail_decomposition(spark: Spark, sf: str) -> DataFrame:
    df = states(spark, sf)
    now = df.groupBy("series").agg(F.max_by("posterior", "t").alias("p")).select("series", F.posexplode("p").alias("state", "weight"))
    out = perf.tails(df).join(now, ["series", "state"])
    return rounded(out.select("series", "state", "weight", (F.col("weight") * F.col("var")).alias("var_part"), (F.col("weight") * F.col("es")).alias("es_part")))


@query(STATES + f""", x AS (SELECT series, t, state, ret, row_number() OVER (PARTITION BY series ORDER BY t) AS n, row_number() OVER (PARTITION BY series ORDER BY t DESC) AS back, run FROM runs0)
SELECT a.series, a.t, a.state, b.n AS run_length FROM x a JOIN (SELECT series, run, count(*) AS n FROM runs0 GROUP BY 1, 2) b USING (series, run) WHERE back = 1""")
def current_state(spark: Spark, sf: str) -> DataFrame:
    return st.current_state(states(spark, sf)).select("series", "t", "state", F.col("run_length").cast("long"))


def fixed_scan(spark: Spark, sf: str) -> tuple[DataFrame, DataFrame]:
    """Blocks of log returns and the fixed model of each series."""
    df = states(spark, sf).select("series", "t", "log_return")
    return scan.block_rows(df, ["log_return"]), scan.one_model(scan.gaussian_model(START, TRANS, MEANS, SDS, "log_return"), df)


_LOGB = ", ".join(f"-0.5 * power((log_return - ({m})) / {s}, 2) - ln({s}) - 0.5 * ln(2 * pi()) AS b{k}" for k, (m, s) in enumerate(zip(MEANS, SDS)))


def _lse(terms: list[str]) -> str:
    return "ln(" + " + ".join(f"exp({x})" for x in terms) + ")"


_FILTER = STATES + f""", o AS (SELECT series, t, ret, row_number() OVER (PARTITION BY series ORDER BY t) AS n, {_LOGB} FROM s),
fl AS (SELECT series, 0::BIGINT AS n, 0::BIGINT AS t, {", ".join(f"ln({p}) AS a{k}" for k, p in enumerate(START))}, 0.0::DOUBLE AS ret FROM (SELECT DISTINCT series FROM s)
UNION ALL SELECT series, n, t, {", ".join(f"u{k} - ln(exp(u0) + exp(u1) + exp(u2))" for k in range(3))}, ret FROM (
    SELECT o.series, o.n, o.t, o.ret, {", ".join(f"b{k} + " + _lse([f"a{j} + ln({TRANS[j, k]})" for j in range(3)]) + f" AS u{k}" for k in range(3))} FROM fl JOIN o ON o.series = fl.series AND o.n = fl.n + 1))
"""


@query(_FILTER + f"SELECT series, t, {r('exp(a0)')} AS f0, {r('exp(a1)')} AS f1, {r('exp(a2)')} AS f2 FROM fl WHERE n > 0")
def online_filter_fixed(spark: Spark, sf: str) -> DataFrame:
    out = scan.filtered(*fixed_scan(spark, sf))
    return rounded(out.select("series", "t", *[F.col("value")[k].alias(f"f{k}") for k in range(3)]))


@query(_FILTER + f"""SELECT series, state, count(*) AS n, {r('avg(ret)')} AS mean, {r('stddev_samp(ret)')} AS sd FROM (SELECT *, CASE WHEN a0 >= a1 AND a0 >= a2 THEN 0 WHEN a1 >= a2 THEN 1 ELSE 2 END AS state FROM fl WHERE n > 0) GROUP BY 1, 2""")
def filtered_state_stats(spark: Spark, sf: str) -> DataFrame:
    """The flagship: bars, features, causal filter, statistics by state."""
    found = scan.filtered(*fixed_scan(spark, sf)).select("series", "t", argmax(F.col("value")).alias("state"))
    out = states(spark, sf).select("series", "t", "ret").join(found, ["series", "t"])
    return rounded(out.groupBy("series", "state").agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd")))


@query(STATES + f""", o AS (SELECT series, t, row_number() OVER (PARTITION BY series ORDER BY t) AS n, {_LOGB} FROM s),
v AS (SELECT series, n, t, {", ".join(f"ln({p}) + b{k} AS v{k}" for k, p in enumerate(START))}, -1 AS k0, -1 AS k1, -1 AS k2 FROM o WHERE n = 1
UNION ALL SELECT o.series, o.n, o.t, {", ".join("b%d + greatest(%s)" % (k, ", ".join(f"v{j} + ln({TRANS[j, k]})" for j in range(3))) for k in range(3))},
{", ".join("CASE WHEN {0} >= {1} AND {0} >= {2} THEN 0 WHEN {1} >= {2} THEN 1 ELSE 2 END".format(*[f"v{j} + ln({TRANS[j, k]})" for j in range(3)]) for k in range(3))} FROM v JOIN o ON o.series = v.series AND o.n = v.n + 1),
last AS (SELECT series, max(n) AS n FROM v GROUP BY 1),
bk AS (SELECT v.series, v.n, v.t, CASE WHEN v0 >= v1 AND v0 >= v2 THEN 0 WHEN v1 >= v2 THEN 1 ELSE 2 END AS state, k0, k1, k2 FROM v JOIN last USING (series, n)
UNION ALL SELECT v.series, v.n, v.t, CASE bk.state WHEN 0 THEN bk.k0 WHEN 1 THEN bk.k1 ELSE bk.k2 END, v.k0, v.k1, v.k2 FROM bk JOIN v ON v.series = bk.series AND v.n = bk.n - 1)
SELECT series, t, state FROM bk""")
def viterbi_fixed(spark: Spark, sf: str) -> DataFrame:
    return scan.viterbi(*fixed_scan(spark, sf)).select("series", "t", F.col("value").alias("state"))
