"""Recursions, dependence, series against series, portfolios, execution."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fold import fold
from ..functions.posterior import dot, numbers
from ..functions.rolling import order, so_far
from ..operators import dependence as dep
from ..operators import moments, scan
from ..operators import performance as perf
from ..operators import portfolio as pf
from ..operators import recursions as rec
from ..operators import states as st
from ..sources import bars
from .base import STATES, query, r, rounded, states

Spark = SparkSession

_N = ", o AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY t) AS n FROM s)"


@query(STATES + _N + f""", v AS (SELECT series, greatest(var_pop(ret), 1e-8) AS v FROM s GROUP BY 1),
g AS (SELECT o.series, o.t, o.n, v.v AS s2, o.ret FROM o JOIN v USING (series) WHERE n = 1
UNION ALL SELECT o.series, o.t, o.n, greatest(1e-5 + 0.1 * power(g.ret - 0.0002, 2) + 0.8 * g.s2, 1e-12), o.ret FROM g JOIN o ON o.series = g.series AND o.n = g.n + 1)
SELECT series, t, {r('sqrt(s2)', 9)} AS vol FROM g""")
def garch_vol_fixed(spark: Spark, sf: str) -> DataFrame:
    out = fold(states(spark, sf), lambda x: {"vol": np.sqrt(rec.garch_variance(x, 1e-5, 0.1, 0.8, 0.0002))}, ["ret"], {"vol": "double"})
    return rounded(out, 9)


@query(STATES + _N + f""", k AS (SELECT series, 0::BIGINT AS n, 0::BIGINT AS t, 0.0::DOUBLE AS x, 0.0::DOUBLE AS v, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b, 1.0::DOUBLE AS c FROM (SELECT DISTINCT series FROM s)
UNION ALL SELECT series, n, t, px + pa / (pa + 1.0) * (y - px), v + pb / (pa + 1.0) * (y - px), pa - pa * pa / (pa + 1.0), pb - pa * pb / (pa + 1.0), pc - pb * pb / (pa + 1.0)
FROM (SELECT o.series, o.n, o.t, o.log_return AS y, k.x + k.v AS px, k.v AS v, k.a + 2 * k.b + k.c + 1e-4 AS pa, k.b + k.c AS pb, k.c + 1e-4 AS pc FROM k JOIN o ON o.series = k.series AND o.n = k.n + 1))
SELECT series, t, {r('x')} AS level, {r('a')} AS variance FROM k WHERE n > 0""")
def kalman_trend_fixed(spark: Spark, sf: str) -> DataFrame:
    def run(y):
        out = rec.kalman_level_velocity(y, 1.0)
        return {"level": out["level"], "variance": out["variance"]}

    return rounded(fold(states(spark, sf), run, ["log_return"], {"level": "double", "variance": "double"}))


@query(STATES + _N + f""", q AS (SELECT *, (p0 * (1 - exp(-ln(2) / 5.0)) + p1 * (1 - exp(-ln(2) / 20.0))) / (p0 + p1 + 1e-15) AS a FROM o),
em AS (SELECT series, t, n, log_return AS y FROM q WHERE n = 1 UNION ALL SELECT q.series, q.t, q.n, q.a * q.log_return + (1 - q.a) * em.y FROM em JOIN q ON q.series = em.series AND q.n = em.n + 1)
SELECT series, t, {r('y')} AS ema FROM em""")
def regime_ema(spark: Spark, sf: str) -> DataFrame:
    return rounded(fold(states(spark, sf), lambda x, p: {"ema": rec.ema(x, rec.state_alpha(p, [5.0, 20.0]))}, ["log_return", "posterior"], {"ema": "double"}))


@query(STATES + f"SELECT series, t, {r('p0 * (0.2 * log_return + 0.8 * smoothed_return_w12) + p1 * (0.5 * log_return + 0.5 * smoothed_return_w12) + p2 * (0.9 * log_return + 0.1 * smoothed_return_w12)')} AS signal FROM s")
def composite_signal(spark: Spark, sf: str) -> DataFrame:
    p = F.col("posterior")
    one, two = dot(p, numbers([0.2, 0.5, 0.9])), dot(p, numbers([0.8, 0.5, 0.1]))
    return rounded(states(spark, sf).select("series", "t", (one * F.col("log_return") + two * F.col("smoothed_return_w12")).alias("signal")))


_DD = STATES + """, lv AS (SELECT series, t, exp(sum(ret) OVER (PARTITION BY series ORDER BY t)) AS level FROM s), d AS (SELECT series, t, 1 - level / max(level) OVER (PARTITION BY series ORDER BY t) AS d, row_number() OVER (PARTITION BY series ORDER BY t) AS n FROM lv)"""


@query(_DD + f""", z AS (SELECT series, 0::BIGINT AS t, 0::BIGINT AS n, false AS stopped, 1.0::DOUBLE AS scale FROM (SELECT DISTINCT series FROM d)
UNION ALL SELECT d.series, d.t, d.n, (z.stopped AND d.d > 0.03) OR d.d >= 0.1,
CASE WHEN (z.stopped AND d.d > 0.03) OR d.d >= 0.1 THEN 0.0 WHEN d.d >= 0.05 THEN greatest(0.0, 1 - (d.d - 0.05) / (0.05 + 1e-15)) ELSE 1.0 END FROM z JOIN d ON d.series = z.series AND d.n = z.n + 1)
SELECT series, t, {r('scale')} AS scale FROM z WHERE n > 0""")
def drawdown_scale(spark: Spark, sf: str) -> DataFrame:
    df = states(spark, sf).withColumn("grown", F.exp("ret") - 1)
    return rounded(pf.drawdown_scales(pf.drawdowns(df, "grown")))


_STOPS = STATES + _N + f""", b AS (SELECT series, 0::BIGINT AS n, 0::BIGINT AS t, 1.0::DOUBLE AS eq, 1.0::DOUBLE AS entry, 0.0::DOUBLE AS pos, 0.0::DOUBLE AS net, 0.0::DOUBLE AS held FROM (SELECT DISTINCT series FROM s)
UNION ALL SELECT series, n, t, eq * (1 + pos * ret - abs(target - pos) * 0.001), CASE WHEN abs(target - pos) > 1e-10 AND target != 0 THEN eq ELSE entry END, target, pos * ret - abs(target - pos) * 0.001, pos FROM (
SELECT o.series, o.n, o.t, o.ret, b.eq, b.entry, b.pos, CASE WHEN b.pos != 0 AND ((b.eq - b.entry) / (b.entry + 1e-15) <= -0.03 OR (b.eq - b.entry) / (b.entry + 1e-15) >= 0.05) THEN 0.0 ELSE CASE o.state WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 ELSE 1.0 END END::DOUBLE AS target
FROM b JOIN o ON o.series = b.series AND o.n = b.n + 1))"""


@query(_STOPS + f" SELECT series, t, {r('eq')} AS equity, {r('net')} AS net, {r('held')} AS position, {r('pos - held')} AS trade FROM b WHERE n > 0")
def backtest_stop_loss(spark: Spark, sf: str) -> DataFrame:
    return rounded(_stops(spark, sf))


def _stops(spark: Spark, sf: str) -> DataFrame:
    def run(ret, state):
        return rec.stop_backtest(ret, state, [0.0, 0.5, 1.0], [0.03] * 3, [0.05] * 3)

    return fold(states(spark, sf), run, ["ret", "state"], {"equity": "double", "net": "double", "position": "double", "trade": "double"})


@query(_STOPS + f" SELECT series, t, sign(pos - held)::INT AS direction, {r('abs(pos - held)')} AS size, {r('abs(pos - held) * 0.001')} AS cost FROM b WHERE n > 0 AND abs(pos - held) > 1e-10")
def backtest_trades(spark: Spark, sf: str) -> DataFrame:
    return rounded(perf.trades(_stops(spark, sf)))


@query(_STOPS + f""", x AS (SELECT *, (max(eq) OVER w - eq) / (max(eq) OVER w + 1e-15) AS dd, abs(pos - held) AS size FROM b WHERE n > 0 WINDOW w AS (PARTITION BY series ORDER BY n)),
y AS (SELECT series, arg_max(eq, n) AS last, count(*) AS n_bars, avg(net) AS mean, stddev_samp(net) AS sd, coalesce(stddev_samp(net) FILTER (net < 0), 0) AS down, count(*) FILTER (net < 0) AS n_down, max(dd) AS mdd, avg((net > 0)::INT) AS win, count(*) FILTER (size > 1e-10) AS n_trades, coalesce(avg(size) FILTER (size > 1e-10), 0) AS avg_size FROM x GROUP BY 1)
SELECT series, {r('last - 1')} AS total_return, {r('power(last, 252.0 / n_bars) - 1')} AS ann_return, {r('sd * sqrt(252)')} AS ann_vol, {r('mean / (sd + 1e-15) * sqrt(252)')} AS sharpe, {r('CASE WHEN n_down > 0 THEN mean / (down + 1e-15) * sqrt(252) END')} AS sortino, {r('mdd')} AS max_drawdown,
{r('(power(last, 252.0 / n_bars) - 1) / (mdd + 1e-15)')} AS calmar, {r('win')} AS win_rate, n_trades, {r('avg_size')} AS avg_trade_size, n_bars FROM y""")
def backtest_tearsheet(spark: Spark, sf: str) -> DataFrame:
    return rounded(perf.tearsheet(_stops(spark, sf)))


@query(STATES + _N + """, a AS (SELECT series, 0::BIGINT AS n, 0::BIGINT AS t, -1 AS prev, 0 AS since, false AS fired, false AS alert FROM (SELECT DISTINCT series FROM s)
UNION ALL SELECT series, n, t, state, CASE WHEN hit THEN 0 ELSE since END, fired OR hit, hit FROM (
SELECT o.series, o.n, o.t, o.state, a.since + 1 AS since, a.fired, a.prev >= 0 AND o.state != a.prev AND CASE o.state WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END >= 0.6 AND (NOT a.fired OR a.since + 1 > 3) AS hit FROM a JOIN o ON o.series = a.series AND o.n = a.n + 1))
SELECT series, t FROM a WHERE alert""")
def alerts_replay(spark: Spark, sf: str) -> DataFrame:
    out = fold(states(spark, sf), lambda k, p: {"alert": rec.alerts(k, p)}, ["state", "posterior"], {"alert": "boolean"})
    return out.where("alert").select("series", "t")


@query(STATES + _N + f""", w AS (SELECT *, CASE state WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS w, exp(sum(ret) OVER (PARTITION BY series ORDER BY t)) * 100 AS price FROM o),
b AS (SELECT series, 0::BIGINT AS n, 0::BIGINT AS t, 100000.0::DOUBLE AS cash, 0.0::DOUBLE AS pos, 0.0::DOUBLE AS average, 0.0::DOUBLE AS realized, -1.0::DOUBLE AS prev, 0.0::DOUBLE AS px FROM (SELECT DISTINCT series FROM s)
UNION ALL SELECT series, n, t, cash - change * fill, CASE WHEN abs(pos + change) < 1e-12 THEN 0.0 ELSE pos + change END,
CASE WHEN abs(pos + change) < 1e-12 THEN 0.0 WHEN change > 0 THEN (pos * average + change * fill) / (pos + change) ELSE average END,
realized + CASE WHEN change < 0 THEN least(-change, pos) * (fill - average) ELSE 0.0 END, w, px FROM (
SELECT *, px * CASE WHEN change > 0 THEN 1.0005 ELSE 0.9995 END AS fill FROM (SELECT *, CASE WHEN abs(raw) < 1e-10 THEN 0.0 ELSE raw END AS change FROM (
SELECT w.series, w.n, w.t, b.cash, b.pos, b.average, b.realized, w.w, w.price AS px, CASE WHEN b.prev < 0 OR abs(w.w - b.prev) > 0.01 THEN (b.cash + b.pos * w.price) * w.w / w.price - b.pos ELSE 0.0 END AS raw FROM b JOIN w ON w.series = b.series AND w.n = b.n + 1))))
SELECT series, t, {r('cash + pos * px', 4)} AS equity, {r('pos', 4)} AS position, {r('realized', 4)} AS realized FROM b WHERE n > 0""")
def paper_portfolio_replay(spark: Spark, sf: str) -> DataFrame:
    """An account that holds the weight of each bar's state, on an index of the returns that starts at 100."""
    df = states(spark, sf).withColumn("price", F.exp(F.sum("ret").over(so_far())) * 100)
    out = fold(df, lambda px, k: rec.paper_trading(px, k, {0: 0.0, 1: 0.5, 2: 1.0}), ["price", "state"], {"equity": "double", "position": "double", "realized": "double"})
    return rounded(out, 4)


_W = """, wr AS (SELECT series, t, k, CASE WHEN sum(w) OVER (PARTITION BY series, k) < 20 THEN 1.0 ELSE w END AS w, {x} AS x, {y} AS y FROM e UNION ALL SELECT series, t, -1, 1.0, {x}, {y} FROM s)"""
_M = """, m AS (SELECT series, k, sum(w) AS sw, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM wr GROUP BY 1, 2),
c AS (SELECT series, k, any_value(sw) AS sw, any_value(mx) AS mx, any_value(my) AS my, sum(w * power(x - mx, 2)) / any_value(sw) AS vx, sum(w * power(y - my, 2)) / any_value(sw) AS vy, sum(w * (x - mx) * (y - my)) / any_value(sw) AS cxy FROM wr JOIN m USING (series, k) GROUP BY 1, 2)"""
_X, _Y = "log_return", "volatility_w24"
_CORR = "CASE WHEN sqrt(vx) * sqrt(vy) > 1e-15 THEN cxy / (sqrt(vx) * sqrt(vy)) ELSE 0.0 END"


@query(STATES + _W.format(x=_X, y=_Y) + _M + f" SELECT series, k AS state, {r('sw')} AS eff_n, {r(_CORR)} AS corr FROM c")
def weighted_corr(spark: Spark, sf: str) -> DataFrame:
    return rounded(dep.state_correlation(states(spark, sf), _X, _Y))


@query(STATES + _W.format(x=_X, y=_Y).replace("wr AS", "wq AS") + """, wr AS (SELECT series, k, w, (sum(w) OVER (PARTITION BY series, k ORDER BY x, t) - w / 2) / sum(w) OVER (PARTITION BY series, k) AS x, (sum(w) OVER (PARTITION BY series, k ORDER BY y, t) - w / 2) / sum(w) OVER (PARTITION BY series, k) AS y FROM wq)""" + _M + f" SELECT series, k AS state, {r('sw')} AS eff_n, {r(_CORR)} AS corr FROM c")
def spearman_weighted(spark: Spark, sf: str) -> DataFrame:
    return rounded(dep.state_correlation(states(spark, sf), _X, _Y, "spearman"))


@query(STATES + """, x AS (SELECT series, t, log_return AS x, volatility_w24 AS y, p0, p1, p2, row_number() OVER (PARTITION BY series ORDER BY t) AS n FROM s),
q AS (SELECT a.series, sign(a.x - b.x) * sign(a.y - b.y) AS s, unnest([0, 1, 2]) AS state, unnest([a.p0 * b.p0, a.p1 * b.p1, a.p2 * b.p2]) AS w FROM x a JOIN x b ON a.series = b.series AND a.n < b.n)""" + f" SELECT series, state, {r('sum(w * s) / sum(w)')} AS tau FROM q GROUP BY 1, 2")
def kendall_weighted(spark: Spark, sf: str) -> DataFrame:
    return rounded(dep.kendall(states(spark, sf), _X, _Y))


_DCC = STATES + _W.format(x=_X, y=_Y) + _M + f""", cc AS (SELECT series, max(CASE WHEN k = 0 THEN {_CORR} END) AS c0, max(CASE WHEN k = 1 THEN {_CORR} END) AS c1, max(CASE WHEN k = 2 THEN {_CORR} END) AS c2 FROM c GROUP BY 1), dc AS (SELECT series, t, p0 * c0 + p1 * c1 + p2 * c2 AS dcc FROM s JOIN cc USING (series))"""


@query(_DCC + f" SELECT series, t, {r('dcc')} AS dcc FROM dc")
def dcc(spark: Spark, sf: str) -> DataFrame:
    df = states(spark, sf)
    return rounded(dep.blended_correlation(df, dep.state_correlation(df, _X, _Y)).select("series", "t", "dcc"))


@query(_DCC + f" SELECT series, t, {r('CASE WHEN count(dcc) OVER w >= 2 THEN stddev_samp(abs(dcc)) OVER w END')} AS breakdown FROM dc WINDOW w AS (PARTITION BY series ORDER BY t ROWS 19 PRECEDING)")
def corr_breakdown(spark: Spark, sf: str) -> DataFrame:
    df = states(spark, sf)
    return rounded(dep.breakdown(dep.blended_correlation(df, dep.state_correlation(df, _X, _Y))).select("series", "t", "breakdown"))


@query(STATES + """, u AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY log_return, t) / (count(*) OVER (PARTITION BY series) + 1) AS u, row_number() OVER (PARTITION BY series ORDER BY volatility_w24, t) / (count(*) OVER (PARTITION BY series) + 1) AS v, p0, p1, p2 FROM s),
l AS (SELECT series, u, v, unnest([0, 1, 2]) AS state, unnest([p0, p1, p2]) AS w FROM u)""" + f" SELECT series, state, {r('sum(CASE WHEN u <= 0.1 AND v <= 0.1 THEN w ELSE 0 END) / greatest(sum(CASE WHEN v <= 0.1 THEN w ELSE 0 END), 1e-15)')} AS lower_tail, {r('sum(CASE WHEN u >= 0.9 AND v >= 0.9 THEN w ELSE 0 END) / greatest(sum(CASE WHEN v >= 0.9 THEN w ELSE 0 END), 1e-15)')} AS upper_tail FROM l GROUP BY 1, 2")
def tail_dependence(spark: Spark, sf: str) -> DataFrame:
    return rounded(dep.tail_dependence(states(spark, sf), _X, _Y))


@query(STATES + _W.format(x=_X, y=_Y) + _M + f" SELECT series, k AS state, {r('sw')} AS eff_n, {r('cxy / (vx + 1e-15)')} AS beta, {r('my - cxy / (vx + 1e-15) * mx')} AS alpha FROM c")
def hedge_ratio(spark: Spark, sf: str) -> DataFrame:
    return rounded(dep.hedge(states(spark, sf), _Y, _X))


@query(STATES + f""", d AS (SELECT series, volatility_w24 - lag(volatility_w24) OVER w AS d, lag(volatility_w24) OVER w AS x FROM s WINDOW w AS (PARTITION BY series ORDER BY t)), f AS (SELECT series, regr_slope(d, x) AS b FROM d WHERE x IS NOT NULL GROUP BY 1)
SELECT series, {r('b')} AS b, {r('CASE WHEN b < 0 AND b > -2 THEN -ln(2) / ln(abs(1 + b)) END', 4)} AS half_life FROM f""")
def half_life(spark: Spark, sf: str) -> DataFrame:
    return rounded(dep.half_life(states(spark, sf), _Y).withColumn("half_life", F.round("half_life", 4)))


@query(STATES + f"SELECT series, t, {r('(log_return - CASE WHEN count(*) OVER w >= 2 THEN avg(log_return) OVER w END) / (stddev_samp(log_return) OVER w + 1e-15)')} AS zscore FROM s WINDOW w AS (PARTITION BY series ORDER BY t ROWS 19 PRECEDING)")
def spread_zscore(spark: Spark, sf: str) -> DataFrame:
    return rounded(dep.spread_zscore(states(spark, sf), "log_return").select("series", "t", "zscore"))


@query(STATES + """, m AS (SELECT series, k, sum(w * log_return) / sum(w) AS m FROM e GROUP BY 1, 2), v AS (SELECT series, k, any_value(m) AS m, sqrt(sum(w * power(log_return - m, 2)) / sum(w)) AS sd FROM e JOIN m USING (series, k) GROUP BY 1, 2),
p AS (SELECT series, max(CASE WHEN k=0 THEN m END) m0, max(CASE WHEN k=1 THEN m END) m1, max(CASE WHEN k=2 THEN m END) m2, max(CASE WHEN k=0 THEN sd END) d0, max(CASE WHEN k=1 THEN sd END) d1, max(CASE WHEN k=2 THEN sd END) d2 FROM v GROUP BY 1)""" + f" SELECT series, t, {r('(log_return - (p0*m0+p1*m1+p2*m2)) / (p0*d0+p1*d1+p2*d2 + 1e-15)')} AS zscore FROM s JOIN p USING (series)")
def regime_spread_zscore(spark: Spark, sf: str) -> DataFrame:
    return rounded(dep.state_spread_zscore(states(spark, sf), "log_return").select("series", "t", "zscore"))


# --- series against series: scores are the tanh of the day's log return ---


def panel(spark: Spark, sf: str) -> DataFrame:
    df = bars.daily_by_status(spark, sf)
    df = df.withColumn("ret", F.ln(F.col("close") / F.lag("close").over(order())) / 100).where("ret is not null")
    return df.withColumn("score", F.tanh(F.col("ret") * 100))


PANEL = """WITH RECURSIVE pb AS (SELECT o_orderstatus AS series, epoch(o_orderdate)::BIGINT AS t, last(o_totalprice ORDER BY o_orderkey) AS close FROM orders WHERE o_totalprice > 0 GROUP BY 1, 2),
pn AS (SELECT *, tanh(ret * 100) AS score FROM (SELECT series, t, ln(close / lag(close) OVER (PARTITION BY series ORDER BY t)) / 100 AS ret FROM pb) WHERE ret IS NOT NULL),
cm AS (SELECT t FROM pn GROUP BY t HAVING count(DISTINCT series) = (SELECT count(DISTINCT series) FROM pn)),
pp AS (SELECT a.series AS series_a, b.series AS series_b, t, a.ret AS ret_a, b.ret AS ret_b, a.score AS score_a, b.score AS score_b FROM pn a JOIN pn b USING (t) JOIN cm USING (t) WHERE a.series < b.series)
"""


@query("WITH bars AS (SELECT event_type AS series, epoch(date_trunc('hour', ts))::BIGINT AS t, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume FROM events WHERE value > 0 GROUP BY 1, 2) SELECT series, t - t % 86400 AS t, first(open ORDER BY t) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY t) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2")
def resample_daily(spark: Spark, sf: str) -> DataFrame:
    return bars.resample(bars.hourly_by_type(spark, sf), 86_400).select("series", "t", "open", "high", "low", "close", "volume")


@query(PANEL + f"SELECT series_a, series_b, {r('corr(ret_a, ret_b)')} AS corr, count(*) AS n FROM pp GROUP BY 1, 2")
def cross_asset_corr(spark: Spark, sf: str) -> DataFrame:
    return rounded(dep.cross_correlation(dep.pairs(panel(spark, sf), "ret"), "ret"))


@query(PANEL + f"SELECT series_a, series_b, CASE WHEN score_a > 0 THEN 'bull' ELSE 'bear' END AS dir_a, CASE WHEN score_b > 0 THEN 'bull' ELSE 'bear' END AS dir_b, count(*) AS n, {r('CASE WHEN count(*) >= 10 THEN corr(ret_a, ret_b) END')} AS corr FROM pp GROUP BY 1, 2, 3, 4")
def conditional_corr(spark: Spark, sf: str) -> DataFrame:
    return rounded(dep.conditional_correlation(dep.pairs(panel(spark, sf), "ret", "score"), "ret"))


@query(PANEL + "SELECT series_a, series_b, CASE WHEN score_a > 0 THEN 'bull' ELSE 'bear' END AS dir_a, CASE WHEN score_b > 0 THEN 'bull' ELSE 'bear' END AS dir_b, count(*) AS n FROM pp GROUP BY 1, 2, 3, 4")
def co_occurrence(spark: Spark, sf: str) -> DataFrame:
    return dep.conditional_correlation(dep.pairs(panel(spark, sf), "ret", "score"), "ret").drop("corr")


@query(PANEL + f"SELECT series_a, series_b, {r('avg(((score_a > 0) = (score_b > 0))::INT)')} AS agreement, {r('corr(score_a, score_b)')} AS score_corr FROM pp GROUP BY 1, 2")
def direction_agreement(spark: Spark, sf: str) -> DataFrame:
    return rounded(dep.agreement(dep.pairs(panel(spark, sf), "score")))


@query(PANEL + f"SELECT series_a, series_b, t, {r('CASE WHEN count(*) OVER w = 20 THEN avg(((score_a > 0) = (score_b > 0))::INT) OVER w END')} AS agreement FROM pp WINDOW w AS (PARTITION BY series_a, series_b ORDER BY t ROWS 19 PRECEDING)")
def rolling_concordance(spark: Spark, sf: str) -> DataFrame:
    return rounded(dep.rolling_agreement(dep.pairs(panel(spark, sf), "score")))


@query(PANEL + f""", x AS (SELECT series_a, series_b, (score_a > 0)::INT::DOUBLE AS a, (score_b > 0)::INT::DOUBLE AS b, row_number() OVER (PARTITION BY series_a, series_b ORDER BY t) AS n FROM pp),
c AS (SELECT x.series_a, x.series_b, lag, CASE WHEN stddev_pop(x.a) > 0 AND stddev_pop(y.b) > 0 THEN corr(x.a, y.b) ELSE 0.0 END AS c FROM x CROSS JOIN (SELECT unnest(range(-10, 11)) AS lag) JOIN x y ON y.series_a = x.series_a AND y.series_b = x.series_b AND y.n = x.n - lag GROUP BY 1, 2, 3 HAVING count(*) >= 2)
SELECT series_a, series_b, lag::INT AS lag, {r('c')} AS corr FROM (SELECT *, row_number() OVER (PARTITION BY series_a, series_b ORDER BY round(c, 12) DESC, lag) AS k FROM c) WHERE k = 1""")
def lead_lag(spark: Spark, sf: str) -> DataFrame:
    return rounded(dep.lead_lag(dep.pairs(panel(spark, sf), "score")))


_SW = PANEL + """, w AS (SELECT *, CASE WHEN sum(greatest(score, 0)) OVER (PARTITION BY t) >= 1e-8 THEN greatest(score, 0) / sum(greatest(score, 0)) OVER (PARTITION BY t) ELSE greatest(score, 0) END AS weight FROM pn)"""


@query(_SW + f" SELECT series, t, {r('weight')} AS weight FROM w")
def score_weights(spark: Spark, sf: str) -> DataFrame:
    return rounded(pf.score_weights(panel(spark, sf)).select("series", "t", "weight"))


@query(PANEL + f""", f AS (SELECT series, t, CASE WHEN count(*) OVER w >= 2 THEN 0.25 * avg(ret) OVER w / greatest(var_samp(ret) OVER w, 1e-8) * sign(score) ELSE 0.0 END AS k FROM pn WINDOW w AS (PARTITION BY series ORDER BY t ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING)), g AS (SELECT *, greatest(k, 0) AS g FROM f)
SELECT series, t, {r('CASE WHEN sum(g) OVER (PARTITION BY t) >= 1e-8 THEN g / sum(g) OVER (PARTITION BY t) ELSE g END')} AS weight FROM g""")
def kelly_weights(spark: Spark, sf: str) -> DataFrame:
    return rounded(pf.kelly_weights(panel(spark, sf)).select("series", "t", "weight"))


@query(_SW + f""", p AS (SELECT t, coalesce(lag(weight) OVER w, 0) * ret AS e, coalesce(abs(weight - lag(weight) OVER w), 0) / 1e4 AS c FROM w WINDOW w AS (PARTITION BY series ORDER BY t)) SELECT t, {r('sum(e) - sum(c)')} AS net FROM p GROUP BY 1""")
def portfolio_returns(spark: Spark, sf: str) -> DataFrame:
    return rounded(pf.portfolio_returns(pf.score_weights(panel(spark, sf))))


@query(_SW + f""", q AS (SELECT a.series AS i, b.series AS j, t, a.weight AS wi, b.weight AS wj, covar_samp(a.ret, b.ret) OVER x AS c, count(*) OVER x AS n FROM w a JOIN w b USING (t) WINDOW x AS (PARTITION BY a.series, b.series ORDER BY t ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING)),
v AS (SELECT t, sum(wi * wj * CASE WHEN n >= 2 THEN c WHEN i = j THEN 0.0001 / 8760 ELSE 0 END) AS v FROM q GROUP BY 1), g AS (SELECT t, sum(abs(weight)) AS g FROM w GROUP BY 1)
SELECT series, t, {r('weight * CASE WHEN g < 1e-8 THEN 0 ELSE least(0.15 / sqrt(greatest(v * 8760, 1e-12)), 2 / g) END')} AS target_weight FROM w JOIN v USING (t) JOIN g USING (t)""")
def vol_target_weights(spark: Spark, sf: str) -> DataFrame:
    return rounded(pf.vol_target(pf.score_weights(panel(spark, sf))).select("series", "t", "target_weight"))


@query(STATES + f"SELECT series, t, {r('p0 * 1.0 + p1 * 0.5 + p2 * 0.25')} AS \"limit\", {r('greatest(least(log_return, p0 + p1 * 0.5 + p2 * 0.25), -(p0 + p1 * 0.5 + p2 * 0.25))')} AS limited FROM s")
def position_limits(spark: Spark, sf: str) -> DataFrame:
    return rounded(pf.limited(states(spark, sf), "log_return", pf.position_limits([0.1, 0.2, 0.4])).select("series", "t", "limit", "limited"))


_IMPACT = STATES + """, m AS (SELECT series, k, sum(w * log_hl_range) / sum(w) AS m, sum(w * volume) / sum(w) AS v FROM e GROUP BY 1, 2), d AS (SELECT series, k, any_value(m) AS m, any_value(v) AS v, sqrt(sum(w * power(log_hl_range - m, 2)) / sum(w)) AS sd FROM e JOIN m USING (series, k) GROUP BY 1, 2),
g AS (SELECT series, stddev_pop(log_hl_range) AS g FROM s GROUP BY 1), ip AS (SELECT series, k AS state, 0.5 * abs(m) AS half_spread, 0.1 * (sd / (g + 1e-10) + 1e-10) AS impact, v AS avg_volume FROM d JOIN g USING (series))"""


@query(_IMPACT + f" SELECT series, state, {r('half_spread')} AS half_spread, {r('impact')} AS impact, {r('avg_volume')} AS avg_volume FROM ip")
def impact_params(spark: Spark, sf: str) -> DataFrame:
    return rounded(pf.impact_parameters(states(spark, sf)))


@query(_IMPACT + f""", w AS (SELECT series, {", ".join(f"max(CASE WHEN state={k} THEN half_spread END) h{k}, max(CASE WHEN state={k} THEN impact END) i{k}, max(CASE WHEN state={k} THEN avg_volume END) v{k}" for k in range(3))} FROM ip GROUP BY 1)
SELECT series, t, {r('p0*h0+p1*h1+p2*h2')} AS spread_cost, {r('(p0*i0+p1*i1+p2*i2) * sqrt(abs(log_return) / (p0*v0+p1*v1+p2*v2 + 1e-10))')} AS impact_cost, state AS likeliest FROM s JOIN w USING (series)""")
def slippage_attribution(spark: Spark, sf: str) -> DataFrame:
    df = states(spark, sf)
    return rounded(pf.slippage_attribution(df, pf.impact_parameters(df), "log_return").select("series", "t", "spread_cost", "impact_cost", "likeliest"))


@query(STATES + f"SELECT series, h AS bucket, {r('100 * v / sum(v) OVER (PARTITION BY series)')} AS size FROM (SELECT series, (t // 3600) % 24 AS h, avg(volume) AS v FROM s GROUP BY 1, 2)")
def vwap_schedule(spark: Spark, sf: str) -> DataFrame:
    hour = F.floor(F.col("t") / 3600) % 24
    return rounded(pf.vwap(states(spark, sf), 100.0, hour))


@query(STATES + f"SELECT series, width_bucket, count(*) AS n FROM (SELECT series, greatest(0, least(81, floor((ret + 0.1) / 0.2 * 80)::BIGINT + 1)) AS width_bucket, state FROM s) GROUP BY 1, 2")
def return_histogram(spark: Spark, sf: str) -> DataFrame:
    """80 bins of returns from -0.1 to 0.1; 0 and 81 are what lies outside."""
    df = states(spark, sf).select("series", F.greatest(F.lit(0), F.least(F.lit(81), F.floor((F.col("ret") + 0.1) / 0.2 * 80) + 1)).cast("long").alias("width_bucket"))
    return df.groupBy("series", "width_bucket").agg(F.count("*").alias("n"))


@query(STATES + f"SELECT series, state, greatest(0, least(81, floor((ret + 0.1) / 0.2 * 80)::BIGINT + 1)) AS width_bucket, count(*) AS n, {r('avg(ret)')} AS mean FROM s GROUP BY 1, 2, 3")
def return_histogram_by_state(spark: Spark, sf: str) -> DataFrame:
    """The same bins for the bars of each state, with the mean return of each bin."""
    bucket = F.greatest(F.lit(0), F.least(F.lit(81), F.floor((F.col("ret") + 0.1) / 0.2 * 80) + 1)).cast("long").alias("width_bucket")
    return rounded(states(spark, sf).groupBy("series", "state", bucket).agg(F.count("*").alias("n"), F.avg("ret").alias("mean")))


@query(STATES + f""", m AS (SELECT series, state, avg(ret) AS mean, avg(volatility_w24) AS risk FROM s GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY mean, state) - 1 AS i, count(*) OVER (PARTITION BY series) AS n, row_number() OVER (PARTITION BY series ORDER BY risk, state) - 1 AS volatility_rank FROM m)
SELECT series, state, {r('mean')} AS mean, CASE n WHEN 3 THEN ['low', 'mid', 'high'][i + 1] WHEN 2 THEN ['bearish', 'bullish'][i + 1] ELSE i::VARCHAR END AS label, volatility_rank::INT AS volatility_rank FROM k""")
def state_ranks(spark: Spark, sf: str) -> DataFrame:
    return rounded(st.labels(states(spark, sf), "ret", "volatility_w24"))


@query(PANEL + f""", ag AS (SELECT series_a, series_b, avg(((score_a > 0) = (score_b > 0))::INT) AS a FROM pp GROUP BY 1, 2)
SELECT series_a, series_b, {r('agreement')} AS agreement, (SELECT {r('avg(a)')} FROM ag) AS overall FROM (SELECT series_a, series_b, a AS agreement FROM ag UNION ALL SELECT series_b, series_a, a FROM ag UNION ALL SELECT DISTINCT x, x, 1.0 FROM (SELECT series_a AS x FROM ag UNION ALL SELECT series_b FROM ag))""")
def concordance_matrix(spark: Spark, sf: str) -> DataFrame:
    """How often the directions of each two series agree, and over all pairs."""
    return rounded(dep.agreement_matrix(dep.pairs(panel(spark, sf), "score")))




@query(STATES + """, d0 AS (SELECT *, volatility_w24 AS y, log_return AS x, lag(volatility_w24) OVER w AS y1, lag(log_return) OVER w AS x1 FROM s WINDOW w AS (PARTITION BY series ORDER BY t)),
z AS (SELECT series, t, y, x, y1, x1, unnest([0, 1, 2, -1]) AS state, unnest([p0, p1, p2, 1.0]) AS w FROM d0), m AS (SELECT series, state, sum(w) AS sw, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM z GROUP BY 1, 2),
f AS (SELECT series, state, any_value(sw) AS sw, sum(w * (x - mx) * (y - my)) / any_value(sw) / (sum(w * power(x - mx, 2)) / any_value(sw) + 1e-15) AS beta, any_value(my) AS my, any_value(mx) AS mx FROM z JOIN m USING (series, state) GROUP BY 1, 2),
g AS (SELECT a.series, a.state, a.sw, CASE WHEN a.state >= 0 AND a.sw < 20 THEN b.beta ELSE a.beta END AS beta, CASE WHEN a.state >= 0 AND a.sw < 20 THEN b.my - b.beta * b.mx ELSE a.my - a.beta * a.mx END AS alpha FROM f a JOIN f b ON a.series = b.series AND b.state = -1),
sp AS (SELECT series, state, w, sw, alpha, beta, y - alpha - beta * x AS s, y1 - alpha - beta * x1 AS s1, y - y1 AS dy, x - x1 AS dx FROM z JOIN g USING (series, state)),
sm AS (SELECT series, state, any_value(sw) AS eff_n, any_value(alpha) AS alpha, any_value(beta) AS beta, sum(w * s) / greatest(any_value(sw), 1) AS mean, regr_slope(s - s1, s1) AS b FROM sp GROUP BY 1, 2),
sd AS (SELECT series, state, sqrt(sum(w * power(s - mean, 2)) / greatest(any_value(sw), 1)) AS sd FROM sp JOIN sm USING (series, state) GROUP BY 1, 2),
dm AS (SELECT series, state, sum(w) AS w0, sum(w * dx) / sum(w) AS ax, sum(w * dy) / sum(w) AS ay FROM sp WHERE dy IS NOT NULL GROUP BY 1, 2),
dv AS (SELECT series, state, sum(w * power(dx - ax, 2)) / any_value(w0) AS vx, sum(w * power(dy - ay, 2)) / any_value(w0) AS vy, sum(w * (dx - ax) * (dy - ay)) / any_value(w0) AS c FROM sp JOIN dm USING (series, state) WHERE dy IS NOT NULL GROUP BY 1, 2),
hl AS (SELECT *, CASE WHEN b < 0 AND b > -2 AND abs(1 + b) > 1e-15 THEN -ln(2) / ln(abs(1 + b)) END AS hl FROM sm),
hw AS (SELECT a.*, least(coalesce(CASE WHEN a.state >= 0 AND a.eff_n < 20 THEN b.hl ELSE a.hl END, 1000), 1000) AS half_life FROM hl a JOIN hl b ON a.series = b.series AND b.state = -1)
""" + f"SELECT series, state, {r('eff_n')} AS eff_n, {r('alpha')} AS alpha, {r('beta')} AS beta, {r('mean')} AS spread_mean, {r('sd')} AS spread_sd, {r('half_life', 4)} AS half_life, {r('(vx + vy) / 2 + sqrt(power((vx - vy) / 2, 2) + c * c) + 1e-10')} AS eigenvalue FROM hw JOIN sd USING (series, state) JOIN dv USING (series, state)")
def regime_spreads(spark: Spark, sf: str) -> DataFrame:
    """Spread, half-life and leading eigenvalue of each state."""
    return rounded(dep.state_spreads(states(spark, sf), _Y, _X).withColumn("half_life", F.round("half_life", 4)))


@query(STATES + """, sc AS (SELECT series, stddev_pop(log_return) AS d0, stddev_pop(volatility_w24) AS d1, count(*) AS n FROM s GROUP BY 1),
z AS (SELECT series, n, [log_return / d0, volatility_w24 / d1] AS z, lead([log_return / d0, volatility_w24 / d1], 1) OVER w AS z1, lead([log_return / d0, volatility_w24 / d1], 2) OVER w AS z2 FROM s JOIN sc USING (series) WINDOW w AS (PARTITION BY series ORDER BY t)),
i AS (SELECT unnest([0, 0, 0, 0, 1, 1, 1, 1]) AS a, unnest([0, 0, 1, 1, 0, 0, 1, 1]) AS b, unnest([0, 1, 0, 1, 0, 1, 0, 1]) AS c)
""" + f"SELECT series, a, b, c, {r('avg(z[a + 1] * z1[b + 1] * z2[c + 1])')} AS third, {r('sum(CASE WHEN c = 0 THEN z[a + 1] * z1[b + 1] END) / nullif(sum(CASE WHEN c = 0 AND z1 IS NOT NULL THEN 1 ELSE 0 END), 0)')} AS second FROM z, i GROUP BY series, a, b, c")
def third_moments(spark: Spark, sf: str) -> DataFrame:
    """Products of three consecutive bars' scaled features, and of two (with c = 0), summed over blocks."""
    names = [_X, _Y]
    m = moments.lagged_moments(scan.block_rows(states(spark, sf), names, 64), names)
    cells = F.array(*(F.struct(F.lit(i // 4).alias("a"), F.lit(i // 2 % 2).alias("b"), F.lit(i % 2).alias("c"), F.col("m3")[i].alias("third"), (F.col("m2")[i // 2] if i % 2 == 0 else F.lit(None).cast("double")).alias("second")) for i in range(8)))
    return rounded(m.select("series", F.explode(cells).alias("x")).select("series", "x.*"))
