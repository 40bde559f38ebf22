"""Helpers that the operators of this folder share."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: Bytes of text that one numpy step works on; temporaries are about ten times that.
STEP_BYTES = 1 << 20


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Unset, a local session gets a temporary folder; any other must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"{tempfile.gettempdir()}/checkpoints"
        os.makedirs(root, exist_ok=True)
        root = f"file://{root}"
    return root.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """A fresh folder there, which goes when the session's file system is closed."""
    path = f"{scratch_root(spark)}/statewell/{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def unused(name: str, columns: list[str]) -> str:
    """``name``, or a longer one that none of ``columns`` has in any case."""
    taken = {x.lower() for x in columns}
    while name.lower() in taken:
        name += "_"
    return name


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of tables that nothing reads any more."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def materialize(df: DataFrame, tag: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, or ``folder`` there, and read it back, which cuts its lineage.

    A lost executor then costs a read and no recomputation.
    """
    path = f"{folder or new_folder(df.sparkSession)}/{tag}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, column: str, tag: str, folder: str | None = None) -> DataFrame:
    """``df`` dealt by ``column`` and written in buckets: joins and groups by it don't shuffle its rows again.

    The table's name goes at once, its files when ``folder`` does or with the session.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{tag}_{uuid.uuid4().hex}"
    path = f"{folder or new_folder(spark)}/{tag}"
    df.repartition(n, column).write.bucketBy(n, column).option("path", path).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of plans that are done with."""
    gc.collect()
    spark._jvm.System.gc()


def tidy(run: Callable) -> Callable:
    """An Arrow function that hands memory back when its task ends, as Spark reuses its process."""

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim:
                trim(0)

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            inv = pow(self.BASE, -1, 1 << 64)
            self.up = np.cumprod(np.r_[U64(1), np.full(n - 1, self.BASE, U64)], dtype=U64)
            self.down = np.cumprod(np.r_[U64(1), np.full(n - 1, inv, U64)], dtype=U64)


POWERS = Powers()
#: A random odd value for each byte.
BYTE_VALUES = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums from which :func:`span_hash` takes the hash of any span."""
    n = len(values)
    POWERS.need(n + 1)
    out = np.zeros(n + 1, U64)
    np.cumsum(values * POWERS.up[:n], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start, end) -> np.ndarray:
    """Hash of ``values[start:end]``, the same wherever these values stand."""
    return (sums[end] - sums[start]) * POWERS.down[start]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column and len + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data, offsets


def steps(offsets: np.ndarray, size: int = STEP_BYTES):
    """Row ranges of about ``size`` bytes; one longer row is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of bytes other than ASCII white space."""
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # words end where rows do
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | edge[1:-1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(offsets, s, "right") - 1


#: Bytes beyond which a word is hashed on its own.
LONG_WORD = 64
#: What of eight bytes belongs to a word that has so many left.
TAIL = np.array([0, *((1 << 8 * i) - 1 for i in range(1, 9))], U64)


def word_values(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit value for each word ``data[s:e]``.

    Eight bytes at a time are mixed into the value so far, which is not linear in them, so
    texts made of few letters in patterns don't meet. Words of up to eight bytes and equal
    length never do. Long words are hashed by xxh3.
    """
    size = e - s
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = mix(size.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(1))
    live = np.flatnonzero(size <= LONG_WORD)
    at, left = s[live], size[live]
    while len(live):
        part = np.ascontiguousarray(eight[at]).view("<u8")[:, 0].astype(U64, copy=False) & TAIL[np.minimum(left, 8)]
        out[live] = mix(out[live] ^ part)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    long = np.flatnonzero(size > LONG_WORD)
    if len(long):
        whole = memoryview(np.ascontiguousarray(data))
        out[long] = [xxhash.xxh3_64_intdigest(whole[a:b]) for a, b in zip(s[long].tolist(), e[long].tolist())]
    return out


def long_text_words(data: np.ndarray, size: int = STEP_BYTES) -> np.ndarray:
    """The values of one text's words, ``size`` bytes at a time, cut between words."""
    out, lo = [], 0
    while lo < len(data):
        hi = min(lo + size, len(data))
        while hi < len(data) and not SPACE[data[hi]]:  # a word isn't cut
            ahead = np.flatnonzero(SPACE[data[hi : hi + size]])
            hi = hi + int(ahead[0]) if len(ahead) else min(hi + size, len(data))
        part = data[lo:hi]
        s, e, _ = words_of(part, np.array([0, len(part)]))
        out.append(word_values(part, s, e))
        lo = hi
    return np.concatenate(out) if out else np.zeros(0, U64)
