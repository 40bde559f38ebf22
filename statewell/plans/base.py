"""The frame that most queries start from, in Spark and in SQL.

Hourly bars by type of event; a fixed three-state posterior of each bar's log return
stands in for a fitted model, so that SQL can give the same rows. ``ret`` is the log
return in hundredths, which keeps compounded returns positive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.posterior import argmax, gaussian_posterior
from ..operators.features import DEFAULT, pipeline
from ..sources import bars

CENTRES, SD = (-2.0, 0.0, 2.0), 1.2
DIGITS = 6

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query, and SQL over the same tables if there is any."""

    def keep(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, and never -0."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(expression: str, digits: int = DIGITS) -> str:
    """The same in SQL."""
    return f"round(({expression})::DOUBLE, {digits}) + 0.0"


def feature_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline(bars.hourly_by_type(spark, sf_dir), DEFAULT)


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = feature_frame(spark, sf_dir).withColumn("posterior", gaussian_posterior(F.col("log_return"), CENTRES, SD))
    return df.withColumn("state", argmax(F.col("posterior"))).withColumn("ret", F.col("log_return") / 100)


BARS = """
bars AS (
    SELECT event_type AS series, epoch(date_trunc('hour', ts))::BIGINT AS t,
           first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
           last(value ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume
    FROM events WHERE value > 0 GROUP BY 1, 2
)"""
FEATURES = BARS + """, f0 AS (
    SELECT *, ln(close / lag(close) OVER (PARTITION BY series ORDER BY t)) AS log_return,
           ln(1 + volume) AS log_volume, ln(high / low) AS log_hl_range FROM bars
), f1 AS (
    SELECT *,
        CASE WHEN count(log_return) OVER w24 = 24 THEN stddev_samp(log_return) OVER w24 END AS volatility_w24,
        CASE WHEN count(log_return) OVER w12 = 12 THEN avg(log_return) OVER w12 END AS smoothed_return_w12,
        CASE WHEN count(log_volume) OVER w24 = 24 AND stddev_samp(log_volume) OVER w24 > 1e-12
             THEN (log_volume - avg(log_volume) OVER w24) / stddev_samp(log_volume) OVER w24 END AS volume_zscore_w24
    FROM f0 WINDOW w24 AS (PARTITION BY series ORDER BY t ROWS 23 PRECEDING), w12 AS (PARTITION BY series ORDER BY t ROWS 11 PRECEDING)
), features AS (
    SELECT * FROM f1 WHERE log_return IS NOT NULL AND volatility_w24 IS NOT NULL AND smoothed_return_w12 IS NOT NULL AND volume_zscore_w24 IS NOT NULL
)"""
STATES = "WITH RECURSIVE " + FEATURES + f""", s0 AS (
    SELECT *, log_return / 100 AS ret, {", ".join(f"exp(-0.5 * ((log_return - ({c})) / {SD}) * ((log_return - ({c})) / {SD})) AS w{k}" for k, c in enumerate(CENTRES))} FROM features
), s AS (
    SELECT *, w0 / (w0 + w1 + w2) AS p0, w1 / (w0 + w1 + w2) AS p1, w2 / (w0 + w1 + w2) AS p2,
           CASE WHEN w0 >= w1 AND w0 >= w2 THEN 0 WHEN w1 >= w2 THEN 1 ELSE 2 END AS state FROM s0
), e AS (
    SELECT series, t, ret, log_return, volatility_w24, log_hl_range, volume, smoothed_return_w12, unnest([0, 1, 2]) AS k, unnest([p0, p1, p2]) AS w FROM s
), runs0 AS (
    SELECT *, coalesce(sum((state != prev)::INT) OVER (PARTITION BY series ORDER BY t), 0)::BIGINT AS run
    FROM (SELECT *, lag(state) OVER (PARTITION BY series ORDER BY t) AS prev FROM s)
), runs AS (
    SELECT series, run, any_value(state) AS state, count(*) AS length, min(t) AS start FROM runs0 GROUP BY 1, 2
)
"""
