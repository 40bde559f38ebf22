"""Incremental removal of repeated word windows with a log-structured fingerprint index.

The index is a folder of immutable runs and a manifest that names them. A run holds the
phrases (trigger fingerprint ``p``, phrase hash ``u``, first place) of the documents of
one batch, one row for each distinct phrase, bucketed and sorted by ``p`` and ``u``. A new
batch is dealt and sorted once, which makes its run; that is merge-joined with each older
run in their common order, so runs are never shuffled again. What only looks alike is
verified window by window, by 128-bit digests of the words, read from the texts. A run is
merged with the one before it, in their order, unless that has over ``RATIO`` times its rows: runs shrink
geometrically from the oldest on, and a row is written again O(log n) times.

A phrase is taken as repeated if its trigger's value and the xxh3 of all its words are
equal, 128 bits together, neither of which is linear in the words' letters.

Defined results: a null text has no words; a row with a null doc_id is returned
untouched and is not history for others; rows that repeat a doc_id count as one
document (they are not earlier than each other); other columns pass unchanged, but
n_words, n_removed and kept_text are replaced; empty tables give no rows.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from itertools import compress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, drop_shuffles, materialize, new_folder
from .windows import covered, phrase_table, repeated_windows, strip_rows, unclear, window_rows

#: How many times the rows of a new run the one before it may have and be merged with it.
RATIO = 2
#: Ranges of doc_id in which a table is added to an index; enough to merge runs.
BATCHES = 3
RUN = "p BIGINT, u BIGINT, doc_id BIGINT, at BIGINT, own BOOLEAN, many BOOLEAN"


@contextlib.contextmanager
def merge_join_settings(spark: SparkSession):
    """Joins on (p, u) may use buckets of p, and a bucket of one file is known to be sorted."""
    names = {
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
        "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
        "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",  # so that both sides keep their order
    }
    before = {x: spark.conf.get(x) for x in names}
    for x, value in names.items():
        spark.conf.set(x, value)
    try:
        yield
    finally:
        for x, value in before.items():
            spark.conf.set(x, value)


class FingerprintIndex:
    """Sorted runs of the phrases of all documents added so far.

    ``folder`` is on storage that driver and executors share. If it holds a manifest the
    index goes on from there, in this session or another; without ``folder`` the index
    lives in the scratch folder and goes with the session. Runs that a new manifest no
    longer names are deleted, so an index is open in one session at a time. ``fanout``
    instead merges neighbours of the fewest rows until so many runs are left.
    """

    def __init__(self, spark: SparkSession, window: int = 20, k: int = 5, fanout: int | None = None, folder: str | None = None) -> None:
        self.spark, self.fanout = spark, fanout
        self.folder = folder or new_folder(spark)
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.version, state = 0, None
        if self._fs.exists(self._path(self.folder)):
            found = [x.getPath().getName() for x in self._fs.listStatus(self._path(self.folder))]
            versions = [int(x.split("-")[1]) for x in found if x.startswith("manifest-")]
            if versions:
                self.version = max(versions)
                state = json.loads(spark.read.text(f"{self.folder}/manifest-{self.version}").first()[0])
        if state and (state["window"], state["k"]) != (window, k):
            raise ValueError("the index was made with another window or k")
        self.window, self.k = window, k
        self.buckets = state["buckets"] if state else int(spark.conf.get("spark.sql.shuffle.partitions"))
        #: Name and rows of each run, oldest first.
        self.runs: list[tuple[str, int]] = [tuple(x) for x in state["runs"]] if state else []

    def _commit(self) -> None:
        """Name the runs in a new manifest: it is written aside, then renamed."""
        self.version += 1
        state = {"window": self.window, "k": self.k, "buckets": self.buckets, "runs": self.runs}
        aside, final = self._path(f"{self.folder}/_{uuid.uuid4().hex}"), self._path(f"{self.folder}/manifest-{self.version}")
        out = self._fs.create(aside)
        out.writeBytes(json.dumps(state) + "\n")
        out.close()
        if not self._fs.rename(aside, final):
            raise OSError("another writer has committed to this index")

    def _write(self, rows: DataFrame) -> str:
        """Rows that are dealt by ``p`` as a bucketed, sorted run."""
        name = f"run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "p").sortBy("p", "u").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def run(self, name: str) -> DataFrame:
        if not self.spark.catalog.tableExists(name):  # made by another session
            self.spark.sql(f"CREATE TABLE {name} ({RUN}) USING parquet CLUSTERED BY (p) SORTED BY (p, u) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'")
        return self.spark.table(name)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(self.spark, f"{self.folder}/{name}")

    def merged(self, name: str) -> DataFrame:
        """The rows of a batch's run that repeat or must be compared; no side is shuffled.

        ``seen``: an older run has the phrase; ``open``: none has, but there are other
        phrases of its trigger, here or in an older run, or it may repeat itself.
        """
        out = self.run(name).withColumn("seen", F.lit(False)).withColumn("other", F.lit(False))
        for old, _ in self.runs:
            same = self.run(old).select("p", "u", F.lit(True).alias("same"))
            alike = self.run(old).select("p").distinct().withColumn("alike", F.lit(True))
            out = out.join(same.hint("merge"), ["p", "u"], "left").join(alike.hint("merge"), "p", "left")
            out = out.withColumn("seen", F.expr("seen or same is not null")).withColumn("other", F.expr("other or alike is not null")).drop("same", "alike")
        kinds = F.expr("sum(int(not seen)) over (partition by p)")
        out = out.withColumn("open", (kinds > 1) | F.col("other") | F.col("own")).withColumn("open", F.expr("open and not seen"))
        return out.where("seen or many or open")

    def add(self, batch: DataFrame, texts: DataFrame, keep: bool = True) -> DataFrame:
        """Places in ``batch`` (doc_id, at) that history or the batch itself has earlier.

        ``texts`` has the texts of the batch and of history. With ``keep`` the batch's
        run stays in the index. Tables of the batch alone are deleted when its places are written.
        """
        own = new_folder(self.spark)
        new = materialize(phrase_table(batch, "word", self.window, self.k), "phrases", own)
        key = F.struct("doc_id", "at")
        rows = new.where("not known").groupBy("p", "u").agg(F.min(key).alias("key"), F.max(key).alias("last"), F.bool_or("own").alias("own"))
        rows = rows.repartition(self.buckets, "p").select("p", "u", "key.doc_id", "key.at", "own", F.expr("last > key").alias("many"))
        with merge_join_settings(self.spark):
            name = self._write(rows)
            merged = materialize(self.merged(name), "merged", own)
        drop_shuffles(self.spark)
        again = merged.where("seen or many").select("p", "u", key.alias("first"), "seen")
        whole = new.where("not known").join(again, ["p", "u"]).where(F.col("seen") | (key > F.col("first"))).select("doc_id", "at")
        whole = whole.unionByName(new.where("known").select("doc_id", "at"))
        triggers = merged.where("open").select("p").distinct()
        places = [merged.where("open").select("doc_id", "at", F.lit(1).alias("age"))]
        places += [self.run(x).join(triggers, "p", "left_semi").select("doc_id", "at", F.lit(0).alias("age")) for x, _ in self.runs]
        windows = materialize(window_rows(unclear(texts, union_all(places)), "word", self.window), "windows", own)
        drop_shuffles(self.spark)
        parts = repeated_windows(windows).where("age = 1").select("doc_id", "at")
        found = materialize(whole.unionByName(parts), "found")
        delete(self.spark, own)
        if keep:
            self.runs.append((name, self.run(name).count()))
            merged_away = []
            while (i := self.to_merge()) is not None:
                merged_away += self.compact(i)
            self._commit()
            for old in merged_away:
                self._drop(old)
        else:
            self._drop(name)
        drop_shuffles(self.spark)
        return found

    def to_merge(self) -> int | None:
        """The run to be merged with the next one, if any is."""
        sizes = [n for _, n in self.runs]
        if self.fanout is None:
            return len(sizes) - 2 if len(sizes) > 1 and sizes[-2] <= RATIO * sizes[-1] else None
        return min(range(len(sizes) - 1), key=lambda i: sizes[i] + sizes[i + 1]) if len(sizes) > self.fanout else None

    def compact(self, i: int) -> tuple[str, str]:
        """Merge run ``i`` and the next one into one, in their order; their names."""
        (one, _), (two, _) = self.runs[i : i + 2]
        with merge_join_settings(self.spark):
            left, right = (self.run(x).select("p", "u", F.struct("doc_id", "at").alias(f"key_{n}"), F.col("own").alias(f"own_{n}")) for n, x in enumerate((one, two)))
            both = left.join(right.hint("merge"), ["p", "u"], "full_outer").withColumn("key", F.least("key_0", "key_1"))
            name = self._write(both.select("p", "u", "key.doc_id", "key.at", F.coalesce("own_0", "own_1").alias("own"), F.lit(False).alias("many")))
        self.runs[i : i + 2] = [(name, self.run(name).count())]
        return one, two


def union_all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def _strip(window: int):
    def strip(texts: list[str | None], spans: list[list[int] | None]) -> list[pa.Array]:
        n_words, n_removed, kept = [], [], []
        for text, places in zip(texts, spans):
            words = (text or "").encode().split()
            gone = covered(places, window, len(words))
            n_words.append(len(words))
            if gone is not None:
                words = list(compress(words, (~gone).tolist()))
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
        return [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]

    return strip


def dedup_substrings(docs: DataFrame, window: int = 20, k: int = 5, batches: int = BATCHES, fanout: int | None = None, folder: str | None = None) -> DataFrame:
    """Columns of ``docs`` but text, with n_words, n_removed and kept_text.

    A word goes if a window of ``window`` words covers it that also starts earlier:
    in a smaller doc_id, or before it in its own document. Documents are added to a
    :class:`FingerprintIndex` in ``batches`` ranges of doc_id. With ``folder`` the index
    stays there for documents to come.
    """
    index = FingerprintIndex(docs.sparkSession, window, k, fanout, folder)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    cuts = rows.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)])).first()[0] if batches > 1 else []
    edges = sorted(set(cuts or []))
    found = []
    for i in range(len(edges) + 1):
        inside = so_far = F.lit(True)
        if i > 0:
            inside &= F.col("doc_id") > edges[i - 1]
        if i < len(edges):
            inside &= F.col("doc_id") <= edges[i]
            so_far = F.col("doc_id") <= edges[i]
        found.append(index.add(rows.where(inside), rows.where(so_far), keep=folder is not None or i < len(edges)))
    return strip_rows(docs, union_all(found), _strip(window), "n_words long, n_removed long, kept_text string")
