"""What follows from transition matrices, filters in SQL, execution and controls."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fold import fold
from ..operators import dense, hmm, scan, semi_markov
from ..operators import dependence as dep
from ..operators import performance as perf
from ..operators import portfolio as pf
from ..operators import recursions as rec
from ..operators import states as st
from .base import STATES, query, r, rounded, states
from .queries_core import _LOGB, _RISK, START, TRANS, _lse, fixed_scan
from .queries_more import _CORR, _DD, _M, _N, _W, _X, _Y, PANEL, panel

Spark = SparkSession
HORIZONS = (1, 6, 24, 72, 168)

_CHAIN = STATES + """, tr AS (SELECT series, state AS i, nxt AS j, count(*) AS c FROM (SELECT series, state, lead(state) OVER (PARTITION BY series ORDER BY t) AS nxt FROM s) WHERE nxt IS NOT NULL GROUP BY 1, 2, 3),
g3 AS (SELECT series, i, j FROM (SELECT DISTINCT series FROM tr), (SELECT unnest([0, 1, 2]) AS i), (SELECT unnest([0, 1, 2]) AS j)),
a AS (SELECT g3.series, g3.i, g3.j, CASE WHEN sum(c) OVER w IS NULL THEN (g3.i = g3.j)::INT ELSE coalesce(c, 0) / sum(c) OVER w END::DOUBLE AS p FROM g3 LEFT JOIN tr USING (series, i, j) WINDOW w AS (PARTITION BY g3.series, g3.i))"""
_POWERS = _CHAIN + """, pw AS (SELECT series, 1 AS h, i, j, p FROM a UNION ALL SELECT m.series, m.h + 1, m.i, b.j, sum(m.p * b.p) FROM pw m JOIN a b ON m.series = b.series AND m.j = b.i WHERE m.h < {h} GROUP BY m.series, m.h, m.i, b.j)"""
_TREE = _CHAIN + """, x AS (SELECT series, """ + ", ".join(f"max(CASE WHEN i = {i} AND j = {j} THEN p END) AS p{i}{j}" for i in range(3) for j in range(3)) + """ FROM a GROUP BY 1),
tree AS (SELECT series, p10 * p20 + p12 * p20 + p21 * p10 AS w0, p01 * p21 + p02 * p21 + p20 * p01 AS w1, p02 * p12 + p01 * p12 + p10 * p02 AS w2 FROM x),
pi AS (SELECT series, unnest([0, 1, 2]) AS state, unnest([w0, w1, w2]) / (w0 + w1 + w2) AS p FROM tree)"""


@query(_POWERS.format(h=168) + f"""SELECT series, h AS horizon, i AS state, j AS "to", {r('p')} AS p FROM pw WHERE h IN (1, 6, 24, 72, 168)""")
def transition_forecast(spark: Spark, sf: str) -> DataFrame:
    return rounded(st.chains(states(spark, sf), 3, lambda m: st.forecast(m, HORIZONS), "horizon int, state int, to int, p double"))


@query(_POWERS.format(h=24) + f"SELECT series, i AS state, h AS horizon, {r('p')} AS p FROM pw WHERE i = j")
def persistence_forecast(spark: Spark, sf: str) -> DataFrame:
    def make(m):
        return [(k, h + 1, p) for k in range(len(m)) for h, p in enumerate(st.occupancy(m, k, 24))]

    return rounded(st.chains(states(spark, sf), 3, make, "state int, horizon int, p double"))


@query(_CHAIN + f"SELECT series, i AS state, {r('1 / greatest(1 - p, 1e-9)')} AS expected, {r('CASE WHEN p >= 1 THEN 200 ELSE least(p / (1 - p), 200) END')} AS additional FROM a WHERE i = j")
def expected_dwell(spark: Spark, sf: str) -> DataFrame:
    def make(m):
        return [(k, float(e), st.additional_dwell(m, k)) for k, e in enumerate(st.expected_dwell(m))]

    return rounded(st.chains(states(spark, sf), 3, make, "state int, expected double, additional double"))


@query(_TREE + f"SELECT series, state, {r('p')} AS p FROM pi")
def stationary_distribution(spark: Spark, sf: str) -> DataFrame:
    return rounded(st.chains(states(spark, sf), 3, lambda m: [(k, float(p)) for k, p in enumerate(st.stationary(m))], "state int, p double"))


@query(_TREE + f", hr AS (SELECT series, i AS state, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) AS h FROM a GROUP BY 1, 2) SELECT series, {r('sum(p * h)')} AS entropy_rate FROM pi JOIN hr USING (series, state) GROUP BY 1")
def entropy_rate(spark: Spark, sf: str) -> DataFrame:
    return rounded(st.chains(states(spark, sf), 3, lambda m: [(st.entropy_rate(m),)], "entropy_rate double"))


_FORWARD = STATES + _N + f""", ob AS (SELECT *, {_LOGB} FROM o), fw AS (SELECT series, n, t, {", ".join(f"ln({p}) + b{k} AS a{k}" for k, p in enumerate(START))} FROM ob WHERE n = 1
UNION ALL SELECT b.series, b.n, b.t, {", ".join(f"b{k} + " + _lse([f"a{j} - greatest(a0, a1, a2) + ln({TRANS[j, k]})" for j in range(3)]) + " + greatest(a0, a1, a2)" for k in range(3))} FROM fw JOIN ob b ON b.series = fw.series AND b.n = fw.n + 1)"""


@query(_FORWARD + f""", l AS (SELECT series, arg_max(a0, n) AS a0, arg_max(a1, n) AS a1, arg_max(a2, n) AS a2 FROM fw GROUP BY 1)
SELECT series, {r("ln(exp(a0 - greatest(a0, a1, a2)) + exp(a1 - greatest(a0, a1, a2)) + exp(a2 - greatest(a0, a1, a2))) + greatest(a0, a1, a2)")} AS log_likelihood FROM l""")
def log_likelihood(spark: Spark, sf: str) -> DataFrame:
    """Of each series under the fixed model."""
    return rounded(scan.log_likelihood(*fixed_scan(spark, sf)).drop("id"))


_SMOOTH = _FORWARD + f""", bw AS (SELECT ob.series, ob.n, 0.0::DOUBLE AS e0, 0.0::DOUBLE AS e1, 0.0::DOUBLE AS e2 FROM ob JOIN (SELECT series, max(n) AS n FROM ob GROUP BY 1) USING (series, n)
UNION ALL SELECT series, n, x0 - top, x1 - top, x2 - top FROM (SELECT *, greatest(x0, x1, x2) AS top FROM (SELECT bw.series, bw.n - 1 AS n, {", ".join(_lse([f"ln({TRANS[j, k]}) + b{k} + e{k}" for k in range(3)]) + f" AS x{j}" for j in range(3))} FROM bw JOIN ob ON ob.series = bw.series AND ob.n = bw.n WHERE bw.n > 1))),
gm AS (SELECT fw.series, fw.t, fw.n, {", ".join(f"exp(a{k} + e{k} - greatest(a0 + e0, a1 + e1, a2 + e2)) AS g{k}" for k in range(3))} FROM fw JOIN bw ON fw.series = bw.series AND fw.n = bw.n)"""


@query(_SMOOTH + f""" SELECT series, t, {", ".join(r(f"g{k} / (g0 + g1 + g2)") + f" AS s{k}" for k in range(3))} FROM gm""")
def smoothed_fixed(spark: Spark, sf: str) -> DataFrame:
    """Forward-backward posteriors under the fixed model."""
    out = scan.smoothed(*fixed_scan(spark, sf))
    return rounded(out.select("series", "t", *[F.col("value")[k].alias(f"s{k}") for k in range(3)]))


@query(_SMOOTH + f""", gx AS (SELECT gm.series, gm.n, o.log_return AS x, unnest([0, 1, 2]) AS state, unnest([g0, g1, g2]) / (g0 + g1 + g2) AS g FROM gm JOIN o ON o.series = gm.series AND o.n = gm.n),
mn AS (SELECT series, state, sum(g * x) / sum(g) AS mean, sum(CASE WHEN n = 1 THEN g END) AS start FROM gx GROUP BY 1, 2),
va AS (SELECT series, state, any_value(mean) AS mean, any_value(start) AS start, sum(g * power(x - mean, 2)) / sum(g) + 1e-4 AS var FROM gx JOIN mn USING (series, state) GROUP BY 1, 2),
ij AS (SELECT unnest([0, 0, 0, 1, 1, 1, 2, 2, 2]) AS i, unnest([0, 1, 2, 0, 1, 2, 0, 1, 2]) AS j, unnest({[float(v) for v in TRANS.ravel()]}) AS p),
xi AS (SELECT fw.series, fw.n, i, j, [a0, a1, a2][i + 1] - greatest(a0, a1, a2) + ln(p) + [b0 + e0, b1 + e1, b2 + e2][j + 1] AS v FROM fw JOIN ob ON ob.series = fw.series AND ob.n = fw.n + 1 JOIN bw ON bw.series = fw.series AND bw.n = fw.n + 1, ij),
xn AS (SELECT series, n, i, j, exp(v - m) / sum(exp(v - m)) OVER (PARTITION BY series, n) AS g FROM (SELECT *, max(v) OVER (PARTITION BY series, n) AS m FROM xi)),
xs AS (SELECT series, i, j, sum(g) AS c FROM xn GROUP BY 1, 2, 3),
xt AS (SELECT series, i AS state, sum(CASE WHEN j = 0 THEN c END) / sum(c) AS t0, sum(CASE WHEN j = 1 THEN c END) / sum(c) AS t1, sum(CASE WHEN j = 2 THEN c END) / sum(c) AS t2 FROM xs GROUP BY 1, 2),
l AS (SELECT series, arg_max(a0, n) AS a0, arg_max(a1, n) AS a1, arg_max(a2, n) AS a2 FROM fw GROUP BY 1)
SELECT series, state, {r('start')} AS start, {r('mean')} AS mean, {r('var')} AS var, {r('t0')} AS t0, {r('t1')} AS t1, {r('t2')} AS t2,
{r("ln(exp(a0 - greatest(a0, a1, a2)) + exp(a1 - greatest(a0, a1, a2)) + exp(a2 - greatest(a0, a1, a2))) + greatest(a0, a1, a2)")} AS log_likelihood FROM va JOIN xt USING (series, state) JOIN l USING (series)""")
def em_step(spark: Spark, sf: str) -> DataFrame:
    """One round of expectation maximisation from the fixed model, and the likelihood before it."""
    out = scan.parameters(scan.em_round(*fixed_scan(spark, sf)))
    t = F.col("trans")
    return rounded(out.select("series", "state", "start", F.col("mean")[0].alias("mean"), F.col("cov")[0][0].alias("var"), *[t[k].alias(f"t{k}") for k in range(3)], "log_likelihood"))


@query(STATES + ", q AS (SELECT *, " + ", ".join("(" + " + ".join(f"p{i} * {TRANS[i, j]}" for i in range(3)) + f")::DOUBLE AS q{j}" for j in range(3)) + " FROM s) SELECT series, t, " + ", ".join(r(f"0.5 * p{k} + 0.5 * q{k}") + f" AS b{k}" for k in range(3)) + " FROM q")
def blended_forecast(spark: Spark, sf: str) -> DataFrame:
    """Mix of each bar's posterior and what the transition matrix makes of it."""
    out = fold(states(spark, sf), lambda p: {"b": semi_markov.blend(p, p @ TRANS).tolist()}, ["posterior"], {"b": "array<double>"})
    return rounded(out.select("series", "t", *[F.col("b")[k].alias(f"b{k}") for k in range(3)]))


@query(STATES + _N + f""", v AS (SELECT series, greatest(var_pop(ret), 1e-8) AS v FROM s GROUP BY 1),
g AS (SELECT o.series, o.n, v.v AS s2, o.ret FROM o JOIN v USING (series) WHERE n = 1
UNION ALL SELECT o.series, o.n, greatest(1e-5 + 0.1 * power(g.ret - 0.0002, 2) + 0.8 * g.s2, 1e-12), o.ret FROM g JOIN o ON o.series = g.series AND o.n = g.n + 1),
l AS (SELECT series, arg_max(s2, n) AS s2 FROM g GROUP BY 1)
SELECT series, horizon, {r('sqrt(greatest(1e-5 / (1 - 0.9) + power(0.9, horizon) * (s2 - 1e-5 / (1 - 0.9)), 1e-12))', 9)} AS vol FROM l, (SELECT unnest([1, 5, 20]) AS horizon)""")
def garch_forecast(spark: Spark, sf: str) -> DataFrame:
    import pandas as pd

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x = g.sort_values("t", kind="stable")["ret"].to_numpy(float)
        sd = float(np.sqrt(rec.garch_variance(x, 1e-5, 0.1, 0.8, 0.0002)[-1]))
        vols = rec.garch_forecast(1e-5, 0.1, 0.8, 0.0002, float(x[-1]), sd, [1, 5, 20])
        return pd.DataFrame({"series": g["series"].iloc[0], "horizon": [1, 5, 20], "vol": vols})

    return rounded(states(spark, sf).select("series", "t", "ret").groupBy("series").applyInPandas(run, "series string, horizon int, vol double"), 9)


@query(STATES + """, v AS (SELECT series, sum(volume) AS total, avg(volume) AS v, avg(log_hl_range) / 2 AS hs FROM s GROUP BY 1), w0 AS (SELECT unnest(range(10))::INT AS slot, power(0.5, unnest(range(10))) AS w),
w1 AS (SELECT slot, w / sum(w) OVER () AS w FROM w0), w2 AS (SELECT slot, CASE WHEN w < 0.01 THEN 0 ELSE w END AS w FROM w1), w3 AS (SELECT slot, w + CASE WHEN slot = 0 THEN 1 - sum(w) OVER () ELSE 0 END AS w FROM w2)""" + f"""
SELECT series, slot, {r('total / 10')} AS twap, {r('total * w')} AS size, (SELECT min(slot) FROM (SELECT slot, sum(w) OVER (ORDER BY slot) AS c FROM w3) WHERE c >= 0.999) AS done, {r('sum(total * w * (hs + 0.1 * sqrt(total * w / (v + 1e-10)))) OVER (PARTITION BY series)')} AS cost FROM v, w3""")
def order_schedules(spark: Spark, sf: str) -> DataFrame:
    """The volume of each series as one order: equal slices, shrinking slices and their cost."""
    import pandas as pd

    totals = states(spark, sf).groupBy("series").agg(F.sum("volume").alias("total"), F.avg("volume").alias("v"), (F.avg("log_hl_range") / 2).alias("hs"))

    def run(batches):
        for b in batches:
            rows = []
            for series, total, v, hs in b.itertuples(index=False):
                sizes, done = pf.order_schedule(total)
                cost = pf.schedule_cost(sizes, hs, 0.1, v)
                rows += [(series, i, x, y, done, cost) for i, (x, y) in enumerate(zip(pf.twap(total, 10), sizes))]
            yield pd.DataFrame(rows, columns=["series", "slot", "twap", "size", "done", "cost"])

    return rounded(totals.mapInPandas(run, "series string, slot int, twap double, size double, done int, cost double"))


@query(_RISK + f""", b0 AS (SELECT series, state, greatest(CASE WHEN n >= 20 THEN coalesce(sharpe, 0) ELSE 0 END, 0) AS x FROM k)
SELECT series, state, {r('CASE WHEN sum(x) OVER w > 0 THEN 0.1 * x / sum(x) OVER w ELSE 0.1 / count(*) OVER w END')} AS budget FROM b0 WINDOW w AS (PARTITION BY series)""")
def drawdown_budget(spark: Spark, sf: str) -> DataFrame:
    import pandas as pd

    def run(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"series": g["series"], "state": g["state"], "budget": pf.drawdown_budget(g["sharpe"].astype(float).tolist())})

    risk = perf.risk_by_state(states(spark, sf)).select("series", "state", "sharpe")
    return rounded(risk.groupBy("series").applyInPandas(run, "series string, state int, budget double"))


@query(PANEL + f""", en AS (SELECT t, sum(x) AS x FROM (SELECT t, coalesce(lag(score) OVER (PARTITION BY series ORDER BY t), 0) * ret AS x FROM pn) GROUP BY 1), lv AS (SELECT t, exp(sum(ln(1 + x)) OVER (ORDER BY t)) AS level FROM en),
d AS (SELECT t, 1 - level / max(level) OVER (ORDER BY t) AS d, row_number() OVER (ORDER BY t) AS n FROM lv),
z AS (SELECT 0::BIGINT AS t, 0::BIGINT AS n, false AS stopped, 1.0::DOUBLE AS scale
UNION ALL SELECT d.t, d.n, (z.stopped AND d.d > 0.03) OR d.d >= 0.1, CASE WHEN (z.stopped AND d.d > 0.03) OR d.d >= 0.1 THEN 0.0 WHEN d.d >= 0.05 THEN greatest(0.0, 1 - (d.d - 0.05) / (0.05 + 1e-15)) ELSE 1.0 END FROM z JOIN d ON d.n = z.n + 1)
SELECT series, t, {r('score')} AS score, {r('scale')} AS scale, {r('score * scale')} AS scaled FROM pn JOIN z USING (t) WHERE z.n > 0""")
def drawdown_control(spark: Spark, sf: str) -> DataFrame:
    return rounded(pf.drawdown_controlled(panel(spark, sf), "score"))


@query(STATES + _W.format(x=_X, y=_Y) + _M + f", cr AS (SELECT series, k, {_CORR} AS corr FROM c WHERE k >= 0) SELECT a.series, {r('avg(sqrt(2) * abs(a.corr - b.corr))')} AS stability FROM cr a JOIN cr b ON a.series = b.series AND a.k < b.k GROUP BY 1")
def correlation_stability(spark: Spark, sf: str) -> DataFrame:
    return rounded(dep.correlation_stability(dep.state_correlation(states(spark, sf), _X, _Y)))


@query(STATES + ", m AS (SELECT series, state, avg(ret) AS mean FROM s GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY mean, state) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM m) SELECT series, state, CASE n WHEN 3 THEN ['low', 'mid', 'high'][i + 1] WHEN 2 THEN ['bearish', 'bullish'][i + 1] ELSE i::VARCHAR END AS label FROM k")
def state_labels(spark: Spark, sf: str) -> DataFrame:
    import pandas as pd

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("state")
        return pd.DataFrame({"series": g["series"], "state": g["state"], "label": hmm.rank_labels(g["mean"].to_numpy())})

    means = states(spark, sf).groupBy("series", "state").agg(F.avg("ret").alias("mean"))
    return means.groupBy("series").applyInPandas(run, "series string, state int, label string")


_MOMENTS = STATES + """, z AS (SELECT series, k, w, log_return AS x, volatility_w24 AS y FROM e), m AS (SELECT series, k, sum(w) AS sw, sum(w*x)/sum(w) AS mx, sum(w*y)/sum(w) AS my FROM z GROUP BY 1, 2),
c AS (SELECT series, k, any_value(mx) AS mx, any_value(my) AS my, sum(w*power(x-mx,2))/any_value(sw) AS a, sum(w*power(y-my,2))/any_value(sw) AS d, sum(w*(x-mx)*(y-my))/any_value(sw) AS b FROM z JOIN m USING (series, k) GROUP BY 1, 2)"""
_QUAD = "({d} * dx * dx - 2 * {b} * dx * dy + {a} * dy * dy) / ({a} * {d} - {b} * {b})"


@query(_MOMENTS + """, pr AS (SELECT p.series, p.k AS i, q.k AS j, p.a AS a1, p.b AS b1, p.d AS d1, q.a AS a2, q.b AS b2, q.d AS d2, q.mx - p.mx AS dx, q.my - p.my AS dy, p.a*p.d-p.b*p.b AS det1, q.a*q.d-q.b*q.b AS det2, (p.a+q.a)/2 AS a3, (p.b+q.b)/2 AS b3, (p.d+q.d)/2 AS d3 FROM c p JOIN c q ON p.series = q.series AND p.k < q.k),
ds AS (SELECT series, i, j, 0.5 * ((d2 * a1 - 2 * b2 * b1 + a2 * d1) / det2 + """ + _QUAD.format(a="a2", b="b2", d="d2") + """ - 2 + ln(det2 / det1)) AS kl, 0.5 * ((d1 * a2 - 2 * b1 * b2 + a1 * d2) / det1 + """ + _QUAD.format(a="a1", b="b1", d="d1") + """ - 2 + ln(det1 / det2)) AS lk,
0.25 * """ + _QUAD.format(a="a3", b="b3", d="d3") + """ + 0.5 * (ln(a3 * d3 - b3 * b3) - 0.5 * (ln(det1) + ln(det2))) AS bh, sqrt(greatest(""" + _QUAD.format(a="a3", b="b3", d="d3") + f""", 0)) AS mh FROM pr)
SELECT series, i AS state_a, j AS state_b, {r('kl')} AS kl, {r('(kl + lk) / 2')} AS symmetric_kl, {r('bh')} AS bhattacharyya, {r('exp(-bh)')} AS coefficient, {r('mh')} AS mahalanobis FROM ds""")
def state_distances(spark: Spark, sf: str) -> DataFrame:
    """All distances between each two states' Gaussians of a series."""
    rows = states(spark, sf).select("series", _X, _Y, F.posexplode("posterior").alias("state", "w"))
    out = dense.by_series(dense.weighted_moments(rows, [_X, _Y], ["series", "state"]), dense.distances, "state_a int, state_b int, kl double, symmetric_kl double, bhattacharyya double, coefficient double, mahalanobis double")
    return rounded(out)


_PMF = "(lgamma({d} - 1 + {r}) - lgamma({r}) - lgamma({d}) + {r} * ln(1 - {p}) + ({d} - 1) * ln({p}))"
_DURATIONS = [(1.5, 0.4), (2.0, 0.3), (1.5, 0.4)]


def _duration_weight(k: int, d: str) -> str:
    n, p = _DURATIONS[k]
    g = min(max(1 - 1 / max(n * p / (1 - p) + 1, 1.0001), 1e-6), 1 - 1e-6)
    return f"exp(least({_PMF.format(d=d, r=n, p=p)} - (ln({1 - g}) + ({d} - 1) * ln({g})), 50))"


@query(STATES + """, ln_ AS (SELECT series, t, state, p0, p1, p2, least(row_number() OVER (PARTITION BY series, run ORDER BY t), 200)::DOUBLE AS d FROM runs0),
cw AS (SELECT series, t, """ + ", ".join(f"p{k} * CASE WHEN state = {k} THEN {_duration_weight(k, 'd')} ELSE {_duration_weight(k, '1.0')} END AS c{k}" for k in range(3)) + " FROM ln_) SELECT series, t, " + ", ".join(r(f"c{k} / (c0 + c1 + c2)") + f" AS c{k}" for k in range(3)) + " FROM cw")
def duration_correction(spark: Spark, sf: str) -> DataFrame:
    out = fold(states(spark, sf), lambda k, p: {"c": semi_markov.correct(k, p, _DURATIONS).tolist()}, ["state", "posterior"], {"c": "array<double>"})
    return rounded(out.select("series", "t", *[F.col("c")[k].alias(f"c{k}") for k in range(3)]))


@query(STATES + _N + f""", q AS (SELECT series, t, n, log_return AS y, (p0 * 1e-3 + p1 * 1e-4) / (p0 + p1 + 1e-15) AS q, avg((p0 * 1e-3 + p1 * 1e-4) / (p0 + p1 + 1e-15)) OVER (PARTITION BY series) AS mq FROM o),
f AS (SELECT series, n, y AS x, mq + 0.01 AS p, mq + 0.01 AS ahead, y AS before FROM q WHERE n = 1
UNION ALL SELECT series, n, px + ahead / (ahead + 0.01 + 1e-15) * (y - px), (1 - ahead / (ahead + 0.01 + 1e-15)) * ahead, ahead, px FROM (SELECT q.series, q.n, q.y, f.x AS px, f.p + q.q AS ahead FROM f JOIN q ON q.series = f.series AND q.n = f.n + 1)),
b AS (SELECT f.series, f.n, f.x AS s, f.before, f.ahead FROM f JOIN (SELECT series, max(n) AS n FROM f GROUP BY 1) USING (series, n)
UNION ALL SELECT f.series, f.n, f.x + f.p / (b.ahead + 1e-15) * (b.s - b.before), f.before, f.ahead FROM b JOIN f ON f.series = b.series AND f.n = b.n - 1)
SELECT b.series, q.t, {r('s')} AS level FROM b JOIN q USING (series, n)""")
def adaptive_kalman(spark: Spark, sf: str) -> DataFrame:
    noise = np.array([1e-3, 1e-4])
    return rounded(fold(states(spark, sf), lambda x, p: {"level": rec.kalman_smoother(x, p[:, :2] @ noise / (p[:, :2].sum(1) + 1e-15), 0.01)}, ["log_return", "posterior"], {"level": "double"}))


@query(STATES + _N + f""", y AS (SELECT o.series, o.n, o.t, e.k, e.w, o.log_return AS y FROM o JOIN e USING (series, t)), mv AS (SELECT series, k, sum(w) AS sw, sum(w * y) / sum(w) AS m FROM y GROUP BY 1, 2),
rv AS (SELECT y.series, y.k, greatest(sum(w * power(y - m, 2)) / any_value(sw), 1e-12) AS rr FROM y JOIN mv USING (series, k) GROUP BY 1, 2),
kf AS (SELECT series, k, rr, 0::BIGINT AS n, 0::BIGINT AS t, 0.0::DOUBLE AS w, 0.0::DOUBLE AS x, 0.0::DOUBLE AS v, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b, 1.0::DOUBLE AS c FROM rv
UNION ALL SELECT series, k, rr, n, t, w, px + pa / (pa + rr) * (y - px), v + pb / (pa + rr) * (y - px), pa - pa * pa / (pa + rr), pb - pa * pb / (pa + rr), pc - pb * pb / (pa + rr)
FROM (SELECT y.series, y.k, kf.rr, y.n, y.t, y.w, y.y, kf.x + kf.v AS px, kf.v AS v, kf.a + 2 * kf.b + kf.c + 1e-4 AS pa, kf.b + kf.c AS pb, kf.c + 1e-4 AS pc FROM kf JOIN y ON y.series = kf.series AND y.k = kf.k AND y.n = kf.n + 1))
SELECT series, t, {r('sum(w * x)')} AS level, {r('max(CASE WHEN k = 0 THEN x END)')} AS level_0, {r('max(CASE WHEN k = 1 THEN x END)')} AS level_1, {r('max(CASE WHEN k = 2 THEN x END)')} AS level_2 FROM kf WHERE n > 0 GROUP BY 1, 2""")
def regime_switching_kalman(spark: Spark, sf: str) -> DataFrame:
    def run(y, p):
        out = rec.switching_levels(y, p)
        return {"level": out["level"], **{f"level_{k}": out["levels"][:, k] for k in range(3)}}

    return rounded(fold(states(spark, sf), run, ["log_return", "posterior"], {x: "double" for x in ("level", "level_0", "level_1", "level_2")}))


def _hp(lam: float, tag: str) -> str:
    """Elimination of the five diagonals forwards, then backwards."""
    return f""", ha{tag} AS (SELECT series, t, n, log_return AS y, m, 1 + {lam} * CASE WHEN n IN (1, m) THEN 1 WHEN n IN (2, m - 1) THEN 5 ELSE 6 END AS a, {lam} * CASE WHEN n IN (1, m - 1) THEN -2 WHEN n = m THEN 0 ELSE -4 END AS b, CASE WHEN n <= m - 2 THEN {lam} ELSE 0.0 END AS c FROM (SELECT *, count(*) OVER (PARTITION BY series) AS m FROM o)),
hf{tag} AS (SELECT series, n, a::DOUBLE AS d, (b / a)::DOUBLE AS e, (c / a)::DOUBLE AS f, y::DOUBLE AS z, 0.0::DOUBLE AS d1, 0.0::DOUBLE AS f1, 0.0::DOUBLE AS z1 FROM ha{tag} WHERE n = 1
UNION ALL SELECT series, n, dd, (b - d * e * f) / dd, c / dd, y - e * z - f1 * z1, d, f, z FROM (SELECT h.series, h.n, h.a - p.d * p.e * p.e - p.d1 * p.f1 * p.f1 AS dd, h.b, h.c, h.y, p.d, p.e, p.f, p.z, p.d1, p.f1, p.z1 FROM hf{tag} p JOIN ha{tag} h ON h.series = p.series AND h.n = p.n + 1)),
hb{tag} AS (SELECT f.series, f.n, f.z / f.d AS x, 0.0::DOUBLE AS x1 FROM hf{tag} f JOIN (SELECT series, max(n) AS n FROM hf{tag} GROUP BY 1) USING (series, n)
UNION ALL SELECT f.series, f.n, f.z / f.d - f.e * b.x - f.f * b.x1, b.x FROM hb{tag} b JOIN hf{tag} f ON f.series = b.series AND f.n = b.n - 1)"""


@query(STATES + _N + _hp(1600.0, "") + f"SELECT o.series, o.t, {r('x')} AS trend FROM hb JOIN o USING (series, n)")
def hp_trend(spark: Spark, sf: str) -> DataFrame:
    return rounded(fold(states(spark, sf), lambda x: {"trend": rec.hp_trend(x, 1600.0)}, ["log_return"], {"trend": "double"}))


@query(STATES + _N + _hp(100.0, "0") + _hp(1600.0, "1") + _hp(14400.0, "2") + f"SELECT o.series, o.t, {r('(p0 * hb0.x + p1 * hb1.x + p2 * hb2.x) / (p0 + p1 + p2 + 1e-15)')} AS trend FROM o JOIN hb0 USING (series, n) JOIN hb1 USING (series, n) JOIN hb2 USING (series, n)")
def regime_hp_trend(spark: Spark, sf: str) -> DataFrame:
    """Trends of three smoothnesses, blended by the posterior."""
    return rounded(fold(states(spark, sf), lambda x, p: {"trend": rec.hp_blend(x, p, [100.0, 1600.0, 14400.0])}, ["log_return", "posterior"], {"trend": "double"}))
