"""Result folders, caches and trade logs as tables."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILL = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("side", T.StringType()),
        *(T.StructField(x, T.DoubleType()) for x in ("quantity", "price", "slippage", "commission")),
    ]
)


def load_results(spark: SparkSession, root: str) -> DataFrame:
    """Decoded bars of every ``root/<symbol>/regimes.parquet``, with the symbol and its states' scores.

    A folder of several series (a column series) gives ``<symbol>/<series>`` for each.

    Scores are joined by state, from ``regime_analytics.parquet`` beside them (columns
    state and sharpe_ann): missing ones count as 0, ties share their mean rank.
    """
    from ..operators.performance import average_rank_scores

    def read(name: str) -> DataFrame:
        df = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/*/{name}")
        folder = F.regexp_extract(F.col("_metadata.file_path"), rf"/([^/]+)/{name}", 1)
        return df.withColumn("series", F.concat_ws("/", folder, "series") if "series" in df.columns else folder)

    bars = read("regimes.parquet")
    scores = average_rank_scores(read("regime_analytics.parquet").select("series", "state", "sharpe_ann"))
    missing = {"t", "ret", "state"} - set(bars.columns)
    if missing:
        raise KeyError(f"regimes.parquet lacks {sorted(missing)}")
    return bars.join(scores, ["series", "state"], "left").fillna(0.0, [x for x in scores.columns if x not in ("series", "state")])


def backtest_inputs(regimes: DataFrame, signals: DataFrame, ret: str = "ret", signal: str = "signal") -> DataFrame:
    """Bars that have both a return and a signal."""
    for df, name in ((regimes, ret), (signals, signal)):
        if name not in df.columns:
            raise KeyError(name)
    return regimes.select("series", "t", ret).join(signals.select("series", "t", signal), ["series", "t"])


def cache_name(symbol: str, period: str, interval: str) -> str:
    return f"{symbol.replace('/', '-')}_{period}_{interval}.parquet"


def cache_is_fresh(spark: SparkSession, path: str, most_seconds: float = 3600) -> bool:
    """Whether a cached table exists and is younger than ``most_seconds``, in any file system Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(p)) and time.time() - fs.getFileStatus(p).getModificationTime() / 1000 < most_seconds


def freshness(spark: SparkSession, path: str, now: float | None = None) -> str:
    """How old a result is, in words."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return "no data"
    age = (time.time() if now is None else now) - fs.getFileStatus(p).getModificationTime() / 1000
    for unit, seconds in (("d", 86_400), ("h", 3_600), ("m", 60)):
        if age >= seconds or unit == "m":
            break
    return f"{int(age // seconds)}{unit} ago"


def cached(spark: SparkSession, path: str, make, most_seconds: float = 3600) -> DataFrame:
    """The table at ``path`` if it is fresh; else what ``make()`` gives, written there."""
    if not cache_is_fresh(spark, path, most_seconds):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def fills(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, FILL)


def save_fills(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Appends to a log of fills, as Parquet or CSV."""
    writer = df.select(FILL.fieldNames()).write.mode("append")
    if kind == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def load_fills(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """A log of fills as it was saved; of repeated ones (a batch written twice) one."""
    reader = spark.read.schema(FILL)
    rows = reader.option("header", True).csv(path) if kind == "csv" else reader.parquet(path)
    return rows.dropDuplicates()


def equity_at_fills(fills_: DataFrame, prices: DataFrame, cash: float) -> DataFrame:
    """Equity after each fill of a symbol: cash and position so far at that time's price, or the fill's own."""
    from pyspark.sql import Window

    up = Window.partitionBy("symbol").orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0)
    units = F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))
    fill = F.col("price") * F.when(F.col("side") == "buy", 1 + F.col("slippage")).otherwise(1 - F.col("slippage"))
    rows = fills_.withColumn("units", units).withColumn("paid", F.col("units") * fill + F.col("commission"))
    rows = rows.withColumn("position", F.sum("units").over(up)).withColumn("cash", cash - F.sum("paid").over(up))
    marked = rows.join(prices.select("symbol", "timestamp", F.col("price").alias("mark")), ["symbol", "timestamp"], "left")
    return marked.select("symbol", "timestamp", "position", "cash", (F.col("cash") + F.col("position") * F.coalesce("mark", "price")).alias("equity"))
