"""Further views of states: entropy ahead, buy and hold, trends by state, factors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fold import fold
from ..functions.posterior import entropy, vector_matrix
from ..functions.rolling import order, rolling, so_far
from ..operators import factors
from ..operators import recursions as rec
from .base import STATES, query, r, rounded, states
from .queries_core import TRANS

Spark = SparkSession
_FEATURES = ["log_return", "volatility_w24"]


@query(STATES + ", q AS (SELECT series, t, " + ", ".join("(" + " + ".join(f"p{i} * {TRANS[i, j]}" for i in range(3)) + f")::DOUBLE AS q{j}" for j in range(3)) + f" FROM s) SELECT series, t, {r('-(q0 * ln(q0) + q1 * ln(q1) + q2 * ln(q2))')} AS entropy FROM q")
def transition_entropy_trajectory(spark: Spark, sf: str) -> DataFrame:
    """Entropy of the next bar's state."""
    ahead = states(spark, sf).withColumn("ahead", vector_matrix(F.col("posterior"), TRANS.tolist()))
    return rounded(ahead.select("series", "t", entropy(F.col("ahead")).alias("entropy")))


@query(STATES + f"SELECT series, t, {r('exp(sum(ln(1 + ret)) OVER (PARTITION BY series ORDER BY t))')} AS buy_and_hold FROM s")
def buy_and_hold(spark: Spark, sf: str) -> DataFrame:
    return rounded(states(spark, sf).select("series", "t", F.product(1 + F.col("ret")).over(so_far()).alias("buy_and_hold")))


@query(STATES + ", n AS (SELECT series, state, count(*) AS n FROM s GROUP BY 1, 2) SELECT series, arg_max(state, n * 10 - state) AS modal_state, max(n) AS n, count(*) AS n_states FROM n GROUP BY 1")
def state_overview(spark: Spark, sf: str) -> DataFrame:
    """The most frequent state of each series (the smallest of ties) and how many there are."""
    n = states(spark, sf).groupBy("series", "state").agg(F.count("*").alias("n"))
    return n.groupBy("series").agg(F.max_by("state", F.struct("n", -F.col("state"))).alias("modal_state"), F.max("n").alias("n"), F.count("*").alias("n_states"))


@query(STATES + f"""SELECT series, t, {r('greatest(-1, least(1, (smoothed_return_w12 - avg(smoothed_return_w12) OVER w) / (coalesce(stddev_samp(smoothed_return_w12) OVER w, 1e-10) + 1e-10)))')} AS trend FROM s WINDOW w AS (PARTITION BY series ORDER BY t ROWS 49 PRECEDING)""")
def trend_signal(spark: Spark, sf: str) -> DataFrame:
    """A level against its last fifty bars, held within -1 and 1."""
    x = F.col("smoothed_return_w12")
    sd = F.coalesce(rolling(F.stddev_samp, x, 50, 2), F.lit(1e-10))
    z = (x - rolling(F.avg, x, 50, 1)) / (sd + 1e-10)
    return rounded(states(spark, sf).select("series", "t", F.greatest(F.least(z, F.lit(1.0)), F.lit(-1.0)).alias("trend")))


_FACTORS = STATES + """, ft AS (SELECT series, t, ret, log_return AS x, volatility_w24 AS y, p0, p1, p2, unnest([0, 1, 2, -1]) AS k, unnest([p0, p1, p2, 1.0]) AS w FROM s),
fm AS (SELECT k, sum(w) AS sw, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM ft GROUP BY 1),
fc AS (SELECT k, any_value(mx) AS mx, any_value(my) AS my, sum(w * power(x - mx, 2)) / any_value(sw) AS a, sum(w * power(y - my, 2)) / any_value(sw) AS d, sum(w * (x - mx) * (y - my)) / any_value(sw) AS b FROM ft JOIN fm USING (k) GROUP BY 1),
fa AS (SELECT *, cos(0.5 * atan2(2 * b, a - d)) AS u, sin(0.5 * atan2(2 * b, a - d)) AS v FROM fc),
fq AS (SELECT CASE WHEN u + v < 0 THEN -u ELSE u END AS ux, CASE WHEN u + v < 0 THEN -v ELSE v END AS uy, CASE WHEN u - v < 0 THEN v ELSE -v END AS vx, CASE WHEN u - v < 0 THEN -u ELSE u END AS vy FROM fa WHERE k = -1),
fl AS (SELECT k, mx, my, u * sign(u * ux + v * uy) AS l00, v * sign(u * ux + v * uy) AS l10, -v * sign(-v * vx + u * vy) AS l01, u * sign(-v * vx + u * vy) AS l11 FROM fa, fq WHERE k >= 0),
fb AS (SELECT series, t, any_value(ret) AS ret, sum(w * l00) AS l00, sum(w * l10) AS l10, sum(w * l01) AS l01, sum(w * l11) AS l11, any_value(x) - sum(w * mx) AS cx, any_value(y) - sum(w * my) AS cy FROM ft JOIN fl USING (k) GROUP BY 1, 2),
fs AS (SELECT *, cx * l00 + cy * l10 AS g0, cx * l01 + cy * l11 AS g1 FROM fb),
fn AS (SELECT sum(g0 * g0) AS s00, sum(g0 * g1) AS s01, sum(g1 * g1) AS s11, sum(g0 * ret) AS y0, sum(g1 * ret) AS y1 FROM fs),
ff AS (SELECT fs.*, g0 * (s11 * y0 - s01 * y1) / (s00 * s11 - s01 * s01) AS c0, g1 * (s00 * y1 - s01 * y0) / (s00 * s11 - s01 * s01) AS c1 FROM fs, fn)"""


@query(_FACTORS + f" SELECT series, t, {r('l00')} AS loading_0, {r('l01')} AS loading_1, {r('g0')} AS factor_0, {r('g1')} AS factor_1, {r('c0', 5)} AS contribution_0, {r('c1', 5)} AS contribution_1, {r('ret - c0 - c1', 5)} AS residual FROM ff")
def factor_projection(spark: Spark, sf: str) -> DataFrame:
    df = states(spark, sf)
    model = factors.fit(df, _FEATURES, 2)
    out = factors.decompose(factors.project(factors.exposure(df, model, 0), _FEATURES, model), "ret", ["factor_0", "factor_1"])
    five = [F.round(c, 5).alias(c) for c in ("contribution_0", "contribution_1", "residual")]
    return rounded(out.select("series", "t", "loading_0", "loading_1", "factor_0", "factor_1", *five))


@query(STATES + """, ft AS (SELECT series, log_return AS x, volatility_w24 AS y, unnest([0, 1, 2, -1]) AS k, unnest([p0, p1, p2, 1.0]) AS w FROM s),
fm AS (SELECT series, k, sum(w) AS sw, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM ft GROUP BY 1, 2),
fc AS (SELECT series, k, sum(w * power(x - mx, 2)) / any_value(sw) AS a, sum(w * power(y - my, 2)) / any_value(sw) AS d, sum(w * (x - mx) * (y - my)) / any_value(sw) AS b FROM ft JOIN fm USING (series, k) GROUP BY 1, 2),
fa AS (SELECT *, cos(0.5 * atan2(2 * b, a - d)) AS u, sin(0.5 * atan2(2 * b, a - d)) AS v, sqrt(power((a - d) / 2, 2) + b * b) AS gap FROM fc),
fo AS (SELECT series, CASE WHEN u + v < 0 THEN -u ELSE u END AS ux, CASE WHEN u + v < 0 THEN -v ELSE v END AS uy, CASE WHEN u - v < 0 THEN v ELSE -v END AS vx, CASE WHEN u - v < 0 THEN -u ELSE u END AS vy FROM fa WHERE k = -1),
fl AS (SELECT series, k, unnest([0, 1]) AS factor, unnest([((a + d) / 2 + gap + 1e-10) / (a + d + 1e-15), ((a + d) / 2 - gap + 1e-10) / (a + d + 1e-15)]) AS share, unnest([u * sign(u * ux + v * uy), -v * sign(-v * vx + u * vy)]) AS l0, unnest([v * sign(u * ux + v * uy), u * sign(-v * vx + u * vy)]) AS l1, unnest([ux, vx]) AS r0, unnest([uy, vy]) AS r1 FROM fa JOIN fo USING (series)),
fs AS (SELECT p.series, p.factor, avg(abs(p.l0 * q.l0 + p.l1 * q.l1)) AS stability FROM fl p JOIN fl q ON p.series = q.series AND p.factor = q.factor AND p.k < q.k AND p.k >= 0 GROUP BY 1, 2)""" + f" SELECT series, k AS state, factor, {r('share')} AS share, {r('l0')} AS loading_0, {r('l1')} AS loading_1, {r('l0 * r0 + l1 * r1')} AS similarity, {r('stability')} AS stability FROM fl JOIN fs USING (series, factor)")
def factor_loadings(spark: Spark, sf: str) -> DataFrame:
    """Factors of each series and state, and how alike they are."""
    out = factors.by_series(states(spark, sf), _FEATURES, 2)
    return rounded(out.select("series", "state", "factor", "share", F.col("loadings")[0].alias("loading_0"), F.col("loadings")[1].alias("loading_1"), "similarity", "stability"))
