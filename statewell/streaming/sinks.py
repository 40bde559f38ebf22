"""What a live run leaves: alert records, fills and account snapshots, each once, and messages to channels."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Alert:
    """A change of state that was likely enough and not too soon after the last one."""

    alert_id: str
    series: str
    t: int
    state: int
    label: str
    confidence: float


def to_log(alert: Alert) -> None:
    log.warning("state of %s is %s since %s, confidence %.3f", alert.series, alert.label, alert.t, alert.confidence)


#: Named targets; any function of an alert is one too.
CHANNELS: dict[str, Callable[[Alert], None]] = {"log": to_log}


def dispatch(alerts: Iterator[Alert], channels: list[str | Callable[[Alert], None]]) -> int:
    """Hands each alert to each channel; one that raises is logged and doesn't keep others from theirs."""
    n = 0
    for alert in alerts:
        for channel in channels:
            try:
                (CHANNELS[channel] if isinstance(channel, str) else channel)(alert)
            except Exception:
                log.exception("alert %s was not delivered", alert.alert_id)
        n += 1
    return n


def alert_records(rows: DataFrame, labels: Mapping[int, str] | None = None) -> DataFrame:
    """The alerts among rows of a live run. An id is made of series and time, so a row seen again has the same."""
    names = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair)) if labels else None
    label = F.coalesce(names[F.col("state")], F.col("state").cast("string")) if names is not None else F.col("state").cast("string")
    found = rows.where("alert")
    return found.select(F.sha2(F.concat_ws("|", "series", F.col("t").cast("string")), 256).alias("alert_id"), "series", "t", "state", label.alias("label"), "confidence")


class LiveSink:
    """A function for ``foreachBatch`` over the rows of ``run_live`` or ``run_stream``.

    A batch's alerts, rows and last account of each series go to folders of their own, named by
    the batch's number and replaced as a whole, so a batch that Spark repeats leaves what it left
    before. Alerts go to channels after their records are written and a mark says that this is done;
    a repeated batch with a mark sends none.
    """

    def __init__(self, folder: str, channels: list[str | Callable[[Alert], None]] | None = None, labels: Mapping[int, str] | None = None) -> None:
        self.folder, self.channels, self.labels = folder.rstrip("/"), ["log"] if channels is None else channels, labels

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            self._write(batch, "rows", number)
            self._write(alert_records(batch, self.labels), "alerts", number)
            last = F.row_number().over(Window.partitionBy("series").orderBy(F.desc("t")))
            self._write(batch.withColumn("__n", last).where("__n = 1").select("series", "t", "state", "position", "equity", "realized"), "accounts", number)
        finally:
            batch.unpersist()
        jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/sent/{number}")
        files = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(jpath):
            written = spark.read.parquet(f"{self.folder}/alerts/batch={number}").orderBy("t", "series")
            dispatch((Alert(**row.asDict()) for row in written.toLocalIterator()), self.channels)
            files.create(jpath).close()

    def _write(self, rows: DataFrame, name: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={number}")


def read_live(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """All batches of "rows", "alerts" or "accounts"."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}").drop("batch")


def latest_accounts(spark: SparkSession, folder: str) -> DataFrame:
    """The newest snapshot of each series: where a run stands."""
    rows = read_live(spark, folder, "accounts")
    return rows.groupBy("series").agg(F.max_by(F.struct("t", "state", "position", "equity", "realized"), "t").alias("s")).select("series", "s.*")


def fills_of(rows: DataFrame, slippage_bps: float = 5.0) -> DataFrame:
    """Trades among rows of a live run: where a series' position changed, with its side and units."""
    before = F.coalesce(F.lag("position").over(Window.partitionBy("series").orderBy("t")), F.lit(0.0))
    change = F.col("position") - before
    return rows.withColumn("change", change).where(F.abs("change") > 1e-10).select("series", "t", F.when(F.col("change") > 0, "buy").otherwise("sell").alias("side"), F.abs("change").alias("quantity"), F.lit(slippage_bps / 1e4).alias("slippage"), "position")


