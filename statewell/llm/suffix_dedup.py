"""Exact removal of repeated byte strings by prefix-free parsing.

Rolling-hash triggers cut each text into overlapping phrases. The dictionary has each
distinct phrase once, the parse says where it occurs first and again. A phrase that
occurs again repeats as a whole. Dictionary phrases that share a trigger may have some
strings in common only: a suffix array of these phrases (prefix doubling, so suffixes
get ranks by 8, 16, 32, 64 and then ``length`` bytes) together with the parse's order
of occurrences gives the corpus order of their ``length``-byte strings; all but the
first of equal rank repeat. Triggers with very many phrases are compared by digests of
the strings instead, which Spark can spread over tasks.

Defined results: a null text is empty; a row with a null doc_id is returned untouched
and is nothing to others; rows that repeat a doc_id count as one document; other
columns pass unchanged, but n_bytes, n_removed, n_spans and kept are replaced; empty
tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_shuffles, materialize, tidy
from .windows import LOW, SHIFT, covered, phrase_table, repeated_windows, strip_rows, unclear, window_rows

#: Phrases of a trigger beyond which their strings are compared by digest.
HOT = 20_000
#: Bytes of dictionary phrases that one suffix array is built of, at least.
BLOCK = 2 << 20


def ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank among the ``length``-byte strings of ``data`` of the one at each place."""
    n = len(data)
    padded = np.r_[data, np.zeros(8, np.uint8)]
    rank = np.zeros(n, np.uint64)
    for i in range(8):
        rank = rank << np.uint64(8) | padded[i : i + n]
    rank, size = np.unique(rank, return_inverse=True)[1], 8
    while size < length:
        step = min(size, length - size)
        ahead = np.r_[rank[step:], np.zeros(min(step, n), rank.dtype)]
        rank = np.unique(rank.astype(np.uint64) << np.uint64(32) | ahead.astype(np.uint64), return_inverse=True)[1]
        size += step
    return rank


def repeats_in(phrases: list[bytes], docs: np.ndarray, starts: np.ndarray, length: int):
    """Places (doc, packed at) of strings in dictionary ``phrases`` that stand earlier.

    ``docs`` and ``starts`` say where each phrase first occurs.
    """
    sizes = np.array([len(x) for x in phrases])
    first = np.r_[0, np.cumsum(sizes)[:-1]]
    rank = ranks(np.frombuffer(b"".join(phrases), np.uint8), length)
    count = sizes - length + 1
    which = np.repeat(np.arange(len(phrases)), count)
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    rank, doc, start = rank[first[which] + inner], docs[which], starts[which] + inner
    order = np.lexsort((start, doc, rank))
    rank, doc, start = rank[order], doc[order], start[order]
    new = np.r_[True, rank[1:] != rank[:-1]]
    head = np.maximum.accumulate(np.where(new, np.arange(len(rank)), 0))
    again = (doc != doc[head]) | (start != start[head])
    doc, start = doc[again], start[again]
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    if not len(doc):
        return doc, start
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
    head = np.flatnonzero(fresh)
    last = start[np.r_[head[1:], len(doc)] - 1]
    pieces = (last - start[head]) // (LOW + 1) + 1  # at most LOW + 1 strings in a packed place
    which = np.repeat(np.arange(len(head)), pieces)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    lo = start[head][which] + nth * (LOW + 1)
    return doc[head][which], lo << SHIFT | np.minimum(last[which] - lo, LOW)


def dictionary_phrases(found: DataFrame, length: int) -> DataFrame:
    """p, doc_id, start and bytes of the unclear phrases."""

    @tidy
    def run(batches):
        names = ["p", "doc_id", "start", "phrase"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc, text, places in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "text", "unclear"))):
                raw = text.encode()
                for place in places:
                    lo = place["at"] >> SHIFT
                    for x, v in zip(out, (place["p"], doc, lo, raw[lo : lo + (place["at"] & LOW) + length])):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names)

    return found.mapInArrow(run, "p long, doc_id long, start long, phrase binary")


def order_families(table: DataFrame, length: int) -> DataFrame:
    """Strings that stand earlier, by suffix arrays over whole families of a trigger."""

    def flush(rows):
        p, docs, starts, phrases = rows
        if phrases:
            doc, at = repeats_in(phrases, np.array(docs, np.int64), np.array(starts, np.int64), length)
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(at)], ["doc_id", "at"])

    @tidy
    def run(batches):
        held: list[list] = [[], [], [], []]
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(x).to_pylist() for x in ("p", "doc_id", "start", "phrase"))):
                if size > BLOCK and row[0] != held[0][-1]:
                    yield from flush(held)
                    held, size = [[], [], [], []], 0
                for x, v in zip(held, row):
                    x.append(v)
                size += len(row[3])
        yield from flush(held)

    return table.repartition("p").sortWithinPartitions("p").mapInArrow(run, "doc_id long, at long")


def _strip(length: int):
    def strip(texts: list[str | None], spans: list[list[int] | None]) -> list[pa.Array]:
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for text, places in zip(texts, spans):
            raw = (text or "").encode()
            gone = covered(places, length, len(raw))
            n_bytes.append(len(raw))
            if gone is None:
                n_spans.append(0)
            else:
                n_spans.append(int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])))
                raw = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            n_removed.append(n_bytes[-1] - len(raw))
            kept.append(raw)
        return [pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)] + [pa.array(kept, pa.binary())]

    return strip


def judge(table: DataFrame, hot: int) -> DataFrame:
    """doc_id, at, p, kind of phrases that stand earlier (0) or must be compared (1; 2 in families of over ``hot``).

    Phrases are dealt by trigger once, which serves both windows; known ones, which are
    compared with none, are spread by their place.
    """
    key = F.struct("doc_id", "at")
    rows = table.withColumn("p", F.expr("if(known, xxhash64(doc_id, at), p)")).repartition("p")
    rows = rows.withColumn("later", F.col("known") | (key > F.min(key).over(Window.partitionBy("p", "u"))))
    of = Window.partitionBy("p")
    rows = rows.withColumn("kinds", F.sum(F.expr("int(not later)")).over(of)).withColumn("self", F.max(F.expr("own and not later")).over(of))
    kind = F.when(F.col("later"), 0).when(F.col("kinds") > hot, 2).when((F.col("kinds") > 1) | F.col("self"), 1)
    return rows.select("doc_id", "at", F.expr("if(later, null, p)").alias("p"), kind.cast("byte").alias("kind")).where("kind is not null")


def dedup_bytes(docs: DataFrame, length: int = 100, k: int = 36, hot: int = HOT) -> DataFrame:
    """Columns of ``docs`` but text, with n_bytes, n_removed, n_spans and kept (binary).

    A byte goes if a string of ``length`` bytes of its document covers it that also
    starts earlier: in a smaller doc_id, or before it in its own document. Families of
    over ``hot`` phrases are compared by digests, which gives the same rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    judged = materialize(judge(phrase_table(rows, "byte", length, k), hot), "judged")
    drop_shuffles(spark)
    places = judged.select("p", "doc_id", "at", F.lit(1).alias("age"), "kind")
    dictionary = materialize(dictionary_phrases(unclear(rows, places.where("kind = 1").drop("kind")), length), "dictionary")
    drop_shuffles(spark)
    ordered = order_families(dictionary, length)
    digests = repeated_windows(window_rows(unclear(rows, places.where("kind = 2").drop("kind", "p")), "byte", length)).select("doc_id", "at")
    whole = judged.where("kind = 0").select("doc_id", "at")
    found = materialize(whole.unionByName(ordered).unionByName(digests), "found")
    drop_shuffles(spark)
    return strip_rows(docs, found, _strip(length), "n_bytes long, n_removed long, n_spans long, kept binary")
