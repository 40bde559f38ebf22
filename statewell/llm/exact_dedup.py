"""Exact duplicates: radix tries own the texts of a length and content hash.

1. Each task inserts its whole texts into a trie. A text that stands there again is
   counted at its end, so a task sends each of its texts once, however many copies it
   has. A row keeps only the number of its local group.
2. Local groups are dealt by length and content hash. The task that gets them inserts
   the full bytes into its trie; equal bytes end at one node, which holds rows, smallest
   and largest id. A trie over its budget gives heavy subtrees away: what ended there
   goes to the shared folder as a partial owner, later texts below pass by, and the next
   round deals them anew. A round settles at least one text a task.
3. Local groups find their owner, then rows find it by local group. A group of very many
   copies has as many local groups as tasks met it, so no key of the rows' join holds
   more than a task's rows.
"""

from __future__ import annotations

import hashlib
import math
import string

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, materialize, new_folder, tidy, unused
from .radix import NODE_BYTES, Trie

#: Bytes of a task's trie beyond which it gives subtrees away.
BUDGET = 64 << 20
#: Bytes of texts in a batch that a task emits.
BATCH_BYTES = 4 << 20
ROWS = "kind string, own long, node long, length long, hash long, text binary, n long, lo long, hi long, sha string, doc_id long"
NAMES = [x.split()[0] for x in ROWS.split(", ")]
SCHEMA = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in ROWS.split(", "))])


def normalised(text: str = "text") -> F.Column:
    """The text with A-Z lower-cased and nothing else changed; null counts as empty."""
    return F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


class _Rows:
    """Rows to emit, in batches of bounded bytes."""

    def __init__(self) -> None:
        self.rows, self.bytes = [], 0

    def add(self, kind: str, **fields) -> None:
        self.rows.append({"kind": kind} | fields)
        self.bytes += 100 + len(fields.get("text") or b"")

    def batches(self, least: int = BATCH_BYTES):
        if self.rows and self.bytes >= least:
            yield pa.RecordBatch.from_pylist(self.rows, SCHEMA)
            self.rows, self.bytes = [], 0


class _Ids:
    """Numbers that no other task of any round gives."""

    def __init__(self, round_: int) -> None:
        self.next = (round_ << 56) + (TaskContext.get().partitionId() << 32)

    def __call__(self) -> int:
        self.next += 1
        return self.next


def _merge(value: list | None, n: int, lo: int | None, hi: int | None, ids: _Ids) -> list:
    """Number, rows, smallest and largest id at an end."""
    if value is None:
        return [ids(), n, lo, hi]
    value[1] += n
    if lo is not None:
        value[2] = lo if value[2] is None else min(value[2], lo)
        value[3] = hi if value[3] is None else max(value[3], hi)
    return value


def local_groups(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Rows ``member`` (doc_id, own) and ``group`` (own, text and what its end holds) of ``docs`` (doc_id, text as bytes)."""

    def group(rows, key, value):
        own, n, lo, hi = value
        rows.add("group", own=own, length=len(key), hash=xxhash.xxh3_64_intdigest(key) - (1 << 63), text=key, n=n, lo=lo, hi=hi)

    @tidy
    def run(batches):
        trie, rows, ids = Trie(), _Rows(), _Ids(0)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                doc, key = doc_id.as_py(), text.as_py()
                end = trie.end(key)
                if end is None:  # its subtree was given away: a local group of its own
                    value = _merge(None, 1, doc, doc, ids)
                    group(rows, key, value)
                else:
                    trie.ends += end.value is None
                    value = end.value = _merge(end.value, 1, doc, doc, ids)
                rows.add("member", doc_id=doc, own=value[0])
                if trie.size > budget and trie.ends > 1:
                    for path, node in trie.spill(budget // 2):
                        group(rows, path, node.value)
                        yield from rows.batches()
                yield from rows.batches()
        for path, node in trie.walk():
            group(rows, path, node.value)
            yield from rows.batches()
        yield from rows.batches(0)

    return docs.mapInArrow(run, ROWS)


def owners(groups: DataFrame, round_: int, budget: int = BUDGET) -> DataFrame:
    """One round over groups that are dealt by length and hash.

    Rows ``link`` (own, node), ``owner`` (node, what its end holds, digest of the text) and
    ``group`` (partial owners, for the next round).
    """

    def group(rows, key, value):
        own, n, lo, hi = value
        rows.add("group", own=own, length=len(key), hash=xxhash.xxh3_64_intdigest(key) - (1 << 63), text=key, n=n, lo=lo, hi=hi)

    @tidy
    def run(batches):
        trie, rows, ids = Trie(), _Rows(), _Ids(round_)
        for batch in batches:
            columns = [batch.column(x) for x in ("own", "text", "n", "lo", "hi")]
            for cells in zip(*columns):
                own, key, n, lo, hi = (x.as_py() for x in cells)
                end = trie.end(key)
                if end is None:
                    group(rows, key, [own, n, lo, hi])
                else:
                    trie.ends += end.value is None
                    end.value = _merge(end.value, n, lo, hi, ids)
                    rows.add("link", own=own, node=end.value[0])
                if trie.size > budget and trie.ends > 1:
                    for path, node in trie.spill(budget // 2):
                        group(rows, path, node.value)
                        yield from rows.batches()
                yield from rows.batches()
        for path, node in trie.walk():
            node_id, n, lo, hi = node.value
            rows.add("owner", node=node_id, n=n, lo=lo, hi=hi, sha=hashlib.sha256(path).hexdigest())
            yield from rows.batches()
        yield from rows.batches(0)

    return groups.select("own", "text", "n", "lo", "hi").mapInArrow(run, ROWS)


def exact_copies(docs: DataFrame, keep: str = "largest", budget: int = BUDGET) -> DataFrame:
    """One row per row of ``docs``: doc_id, first_id, last_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when the same after lower-casing A-Z only. ``keep`` is "largest" or
    "smallest": which doc_id of a group stays.

    Defined results: null text is the empty text; rows that repeat a doc_id with the
    same text all count in group_size and are kept or dropped together; with other texts
    each belongs to its own group. A null doc_id never stays where another row of its
    group has an id; alone, it stays and keep_id is null. Other columns aren't read;
    an empty table gives no rows. Texts of any length are compared whole.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep must be largest or smallest")
    spark = docs.sparkSession
    folder = new_folder(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().cast("binary").alias("text"))
    local = materialize(local_groups(rows, budget), "local", folder)
    members, groups = local.where("kind = 'member'").select("doc_id", "own"), local.where("kind = 'group'")
    found, round_, at = None, 0, groups.select("own", F.col("own").alias("at"))
    while True:
        round_ += 1
        held = groups.agg(F.sum(F.col("length") + NODE_BYTES)).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(2 * held / budget))
        done = materialize(owners(groups.repartition(parts, "length", "hash", F.lit(round_)), round_, budget), f"round_{round_}", folder)
        links = done.where("kind = 'link'").select(F.col("own").alias("at"), "node")
        at = at.join(links, "at", "left").select("own", F.coalesce("node", "at").alias("at"))
        settled = done.where("kind = 'owner'").select(F.col("node").alias("at"), "n", "lo", "hi", "sha")
        found = settled if found is None else found.unionByName(settled)
        groups = done.where("kind = 'group'")
        if groups.isEmpty():
            break
    keep_id = F.col("hi" if keep == "largest" else "lo")
    out = members.join(at.join(found, "at"), "own").select(
        "doc_id",
        F.col("lo").alias("first_id"),
        F.col("hi").alias("last_id"),
        keep_id.alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    out = materialize(out, "copies")
    delete(spark, folder)
    return out


def drop_copies(docs: DataFrame, keep: str = "largest", budget: int = BUDGET) -> DataFrame:
    """The rows of ``docs`` whose text stays, with all their columns; of rows that repeat id and text, one."""
    key, found_id, found_sha = (unused(x, docs.columns) for x in ("__key", "__found_id", "__found_sha"))
    copies = exact_copies(docs, keep, budget).where("kept").select(F.col("doc_id").alias(found_id), F.col("text_sha256").alias(found_sha)).distinct()
    keyed = docs.withColumn(key, F.sha2(normalised().cast("binary"), 256))
    kept = keyed.join(copies, (keyed[key] == F.col(found_sha)) & keyed["doc_id"].cast("long").eqNullSafe(F.col(found_id)), "left_semi")
    return kept.dropDuplicates(["doc_id", key]).drop(key)
