"""``spark.read.format("bars")`` and ``readStream``: bars of folders partitioned by series.

A folder is what ``write_bars`` leaves: ``series=<name>`` folders of Parquet files. The
reader plans a partition for each file, drops series by pushed equality, and drops files
whose statistics lie outside pushed bounds of ``t``. As a stream, files are read once each, in the
order they were written; the offset is the time and name of the last one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .bars import BAR

COLUMNS = BAR.fieldNames()


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@dataclass
class File(InputPartition):
    path: str
    series: str
    written: int
    low: float = float("-inf")
    high: float = float("inf")

    def key(self) -> tuple[int, str]:
        return self.written, self.path


def files(path: str) -> list[File]:
    """All bar files below ``path``, with the series their folder names."""
    system, root = _filesystem(path)
    out = []
    for x in system.get_file_info(pafs.FileSelector(root, recursive=True)):
        folder = x.path.rsplit("/", 2)[-2] if x.path.count("/") else ""
        if x.type == pafs.FileType.File and x.path.endswith(".parquet") and folder.startswith("series="):
            out.append(File(x.path, unquote(folder.removeprefix("series=")), x.mtime_ns or 0))
    return sorted(out, key=File.key)


def read_file(part: File, path: str) -> Iterator[pa.RecordBatch]:
    system, _ = _filesystem(path)
    with system.open_input_file(part.path) as f:
        for batch in pq.ParquetFile(f).iter_batches(columns=COLUMNS[1:]):
            t = batch.column("t").to_numpy()
            batch = batch.filter(pa.array((t >= part.low) & (t <= part.high)))
            series = pa.array([part.series] * batch.num_rows, pa.string())
            columns = [batch.column(x).cast(pa.int64() if x == "t" else pa.float64()) for x in COLUMNS[1:]]
            yield pa.RecordBatch.from_arrays([series, *columns], COLUMNS)


class BarReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.series, self.low, self.high = path, None, float("-inf"), float("inf")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality of series and bounds of t; Spark applies all others, and strict bounds again."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name == "series" and isinstance(f, (EqualTo, In)):
                given = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.series = given if self.series is None else self.series & given
            elif name == "t" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value)
                if isinstance(f, GreaterThan):
                    yield f
            elif name == "t" and isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value)
                if isinstance(f, LessThan):
                    yield f
            else:
                yield f

    def _inside(self, part: File) -> bool:
        """Whether the file's statistics leave room for the bounds of t."""
        if self.low == float("-inf") and self.high == float("inf"):
            return True
        system, _ = _filesystem(self.path)
        with system.open_input_file(part.path) as f:
            meta = pq.ParquetFile(f).metadata
        for i in range(meta.num_row_groups):
            group = meta.row_group(i)
            stats = next((group.column(j).statistics for j in range(group.num_columns) if group.column(j).path_in_schema == "t"), None)
            if stats is None or not stats.has_min_max or (stats.min <= self.high and stats.max >= self.low):
                return True
        return False

    def partitions(self) -> list[File]:
        found = [x for x in files(self.path) if self.series is None or x.series in self.series]
        return [File(x.path, x.series, x.written, self.low, self.high) for x in found if self._inside(x)]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        return read_file(partition, self.path) if isinstance(partition, File) else iter(())


class BarStream(DataSourceStreamReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:
        return {"written": -1, "path": ""}

    def latestOffset(self) -> dict:
        found = files(self.path)
        return {"written": found[-1].written, "path": found[-1].path} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[File]:
        after, upto = ((x["written"], x["path"]) for x in (start, end))
        return [x for x in files(self.path) if after < x.key() <= upto]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        return read_file(partition, self.path)


class BarSource(DataSource):
    """Options: ``path``, the folder. Paths are local or of a store that Arrow opens (s3, gs, hdfs)."""

    @classmethod
    def name(cls) -> str:
        return "bars"

    def schema(self) -> StructType:
        return BAR

    def _path(self) -> str:
        if not self.options.get("path"):
            raise ValueError("give the folder of bars as path")
        return self.options["path"]

    def reader(self, schema: StructType) -> BarReader:
        return BarReader(self._path())

    def streamReader(self, schema: StructType) -> BarStream:
        return BarStream(self._path())


def register(spark: SparkSession) -> None:
    """Make the format known; filters reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BarSource)
