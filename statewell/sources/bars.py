"""Bar series from event and order tables, and bar files.

A bar is (series, t, open, high, low, close, volume); ``t`` is seconds since 1970, UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR = T.StructType([T.StructField("series", T.StringType()), T.StructField("t", T.LongType()), *(T.StructField(x, T.DoubleType()) for x in ("open", "high", "low", "close", "volume"))])


def seconds(ts: str | Column) -> Column:
    return F.unix_seconds(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def to_bars(ticks: DataFrame, every: int) -> DataFrame:
    """Bars of ``every`` seconds from ticks (series, t, order, price).

    ``order`` breaks ties within a tick's time. One shuffle; all of it is summed before.
    """
    at = F.struct("t", "order")
    return (
        ticks.where("price > 0")
        .groupBy("series", (F.col("t") - F.col("t") % every).alias("bar"))
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.count("*").cast("double").alias("volume"),
        )
        .withColumnRenamed("bar", "t")
    )


def _events(spark: SparkSession, sf_dir: str, series: Column) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(series.alias("series"), F.floor(us / 1_000_000).alias("t"), F.struct(us.alias("us"), "event_id").alias("order"), F.col("value").alias("price"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series of all events, by the hour."""
    return to_bars(_events(spark, sf_dir, F.lit("all")), 3600)


def hourly_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series for each type of event, by the hour."""
    return to_bars(_events(spark, sf_dir, F.col("event_type")), 3600)


def daily_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series for each status of order, by the day."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    ticks = o.select(F.col("o_orderstatus").alias("series"), seconds("o_orderdate").alias("t"), F.col("o_orderkey").alias("order"), F.col("o_totalprice").alias("price"))
    return to_bars(ticks, 86_400)


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series of all orders, by the day."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    ticks = o.select(F.lit("all").alias("series"), seconds("o_orderdate").alias("t"), F.col("o_orderkey").alias("order"), F.col("o_totalprice").alias("price"))
    return to_bars(ticks, 86_400)


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BAR).parquet(path)


def write_bars(bars: DataFrame, path: str) -> None:
    """Partitioned by series, so that reads of few series skip the rest."""
    bars.repartition("series").sortWithinPartitions("series", "t").write.mode("overwrite").partitionBy("series").parquet(path)


def resample(bars: DataFrame, every: int) -> DataFrame:
    """Coarser bars of ``every`` seconds, with the sum of log returns if there is one."""
    sums = [F.sum("log_return").alias("log_return")] if "log_return" in bars.columns else []
    return (
        bars.groupBy("series", (F.col("t") - F.col("t") % every).alias("bar"))
        .agg(F.min_by("open", "t").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "t").alias("close"), F.sum("volume").alias("volume"), *sums)
        .withColumnRenamed("bar", "t")
    )
