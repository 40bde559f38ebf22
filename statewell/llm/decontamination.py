"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item that share a seed (``least`` consecutive tokens, by
Karp-Rabin rolling hash) are tiled: the longest match of unmarked tokens is marked in
both, again and again, down to ``least`` tokens. Tiles don't overlap and may stand in
any order, so reordered passages count. A document leaks an item when tiles cover
``threshold`` of the item's tokens.

Tokens are runs of ASCII letters and digits and of non-ASCII characters, lower-cased.
The benchmark is sent to every task if its seeds are ``max_sent`` at most, which is
checked; beyond that, seeds meet in a shuffle join. Both give the same rows.

Defined results: null or empty texts and items match nothing; an item of fewer than
``least`` tokens matches where all of it stands in a row; rows that repeat a doc_id
are judged each, rows that repeat an item_id too; other columns aren't read, whatever
their names; texts of any length are tiled whole; empty tables give no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, prefix_sums, span_hash, steps, text_buffers, tidy, unused, word_values

LEAKS = "doc_id long, item_id long, item_tokens long, n_tiles long, covered long, coverage double"
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def token_values(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit value for each token, and the offsets of rows in tokens."""
    solid = WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    end[:-1] &= ~solid[1:] | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return word_values(data, s, e), np.searchsorted(s, offsets)


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    raw = [(x or "").lower().encode() for x in texts]
    return token_values(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64))


def seeds(values: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of each run of ``k`` tokens inside a row."""
    if len(values) < k:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    at = np.arange(len(values) - k + 1)
    row_end = np.repeat(offsets[1:], np.diff(offsets))
    at = at[at + k <= row_end[: len(at)]]
    return at, mix(span_hash(prefix_sums(values), at, at + k) + U64(k))


def tile(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (item place, doc place, length), longest first, of two token sequences."""
    k = min(least, len(item))
    if k == 0 or len(doc) < k:
        return []
    _, a = seeds(item, np.array([0, len(item)]), k)
    _, b = seeds(doc, np.array([0, len(doc)]), k)
    order = np.argsort(a, kind="stable")
    lo, hi = np.searchsorted(a[order], b, "left"), np.searchsorted(a[order], b, "right")
    count = hi - lo
    d = np.repeat(np.arange(len(b)), count)
    i = order[np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())]
    # seeds on one diagonal in a row are one maximal match
    along = np.lexsort((i, d - i))
    i, d = i[along], d[along]
    cut = np.flatnonzero(np.r_[True, (np.diff(d - i) != 0) | (np.diff(i) != 1)]) if len(i) else np.zeros(0, np.int64)
    size = np.diff(np.r_[cut, len(i)]) + k - 1
    in_item, in_doc, out = np.zeros(len(item), bool), np.zeros(len(doc), bool), []
    queue = list(zip((-size).tolist(), i[cut].tolist(), d[cut].tolist()))  # longest first, then by places
    heapq.heapify(queue)
    while queue:
        n, i, d = heapq.heappop(queue)
        n = -n
        taken = in_item[i : i + n] | in_doc[d : d + n]
        if not taken.any():
            in_item[i : i + n] = in_doc[d : d + n] = True
            out.append((i, d, n))
            continue
        free = np.flatnonzero(np.diff(np.r_[True, taken, True].astype(np.int8)))
        for p, q in zip(free[::2].tolist(), free[1::2].tolist()):
            if q - p >= k:
                heapq.heappush(queue, (p - q, i + p, d + p))
    return out


class Benchmark:
    """Items' tokens and the items of each seed hash."""

    def __init__(self, items: list[tuple[int | None, str | None]], least: int) -> None:
        self.least, self.ids = least, [x for x, _ in items]
        values, bound = tokens([t for _, t in items])
        self.tokens = [values[a:b] for a, b in zip(bound[:-1], bound[1:])]
        found: dict[int, dict[int, list[int]]] = {}
        for n, item in enumerate(self.tokens):
            k = min(least, len(item))
            if k:
                for h in seeds(item, np.array([0, len(item)]), k)[1].tolist():
                    of = found.setdefault(k, {}).setdefault(h, [])
                    if not of or of[-1] != n:
                        of.append(n)
        self.found = found
        self.marks = {}
        for k, of in found.items():
            mark = np.zeros(1 << 20, bool)
            mark[(np.fromiter(of, U64) & U64((1 << 20) - 1)).astype(np.int64)] = True
            self.marks[k] = mark

    def candidates(self, values: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """Rows and items that share a seed, once each."""
        out = set()
        for k, of in self.found.items():
            at, h = seeds(values, offsets, k)
            maybe = np.flatnonzero(self.marks[k][(h & U64((1 << 20) - 1)).astype(np.int64)])
            rows = np.searchsorted(offsets, at[maybe], "right") - 1
            for row, one in zip(rows.tolist(), h[maybe].tolist()):
                for n in of.get(one, ()):
                    out.add((row, n))
        return sorted(out)


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in LEAKS.split(", ")]
    types = [pa.int64()] * 5 + [pa.float64()]
    columns = list(zip(*rows)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], names)


def _judge(doc_id, doc, item_id, item, least, threshold) -> list[tuple]:
    found = tile(item, doc, least)
    covered = sum(n for _, _, n in found)
    if not found or covered < threshold * len(item):
        return []
    return [(doc_id, item_id, len(item), len(found), covered, covered / len(item))]


def _seed_rows(column: str, least: int, lengths: list[int]):
    """Arrow function: id and each distinct seed of its text, of each of ``lengths``."""

    @tidy
    def run(batches):
        for batch in batches:
            values, bound = tokens(batch.column(1).to_pylist())
            ids = np.arange(len(bound) - 1)
            for k in lengths:
                at, h = seeds(values, bound, k)
                row = np.searchsorted(bound, at, "right") - 1
                if column == "item":  # an item has seeds of one length
                    size = np.diff(bound)[row]
                    fits = np.minimum(size, least) == k
                    row, h = row[fits], h[fits]
                pairs = np.unique(np.stack([ids[row].astype(np.int64), h.view(np.int64)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pairs[:, 0])), pa.array(pairs[:, 1]), pa.array(np.full(len(pairs), k))], ["id", "h", "k"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.5, max_sent: int = 2_000_000) -> DataFrame:
    """A row for each document and item it leaks; see ``LEAKS`` for its columns."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    # an item of n bytes has n seeds at most
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    if size <= max_sent:
        held = Benchmark([tuple(r) for r in items.orderBy("item_id", "text").collect()], least)

        @tidy
        def scan(batches):
            for batch in batches:
                out = []
                data, bound = text_buffers(batch.column(1))
                ids = batch.column(0).to_pylist()
                for i, j in steps(bound):
                    values, off = tokens(batch.column(1)[i:j].to_pylist())
                    for row, n in held.candidates(values, off):
                        out += _judge(ids[i + row], values[off[row] : off[row + 1]], held.ids[n], held.tokens[n], least, threshold)
                yield _emit(out)

        return docs.mapInArrow(scan, LEAKS)

    lengths = list(range(1, least + 1))
    doc_key = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    item_key = items.withColumn("key", F.xxhash64("item_id", "text"))
    from_docs = doc_key.select("key", "text").mapInArrow(_seed_rows("doc", least, lengths), "id long, h long, k long")
    from_items = item_key.select("key", "text").mapInArrow(_seed_rows("item", least, lengths), "id long, h long, k long")
    pairs = from_docs.join(from_items.withColumnRenamed("id", "item"), ["h", "k"]).select("id", "item").distinct()
    full = pairs.join(doc_key.select("doc_id", F.col("text").alias("doc_text"), F.col("key").alias("id")), "id").join(item_key.select("item_id", F.col("text").alias("item_text"), F.col("key").alias("item")), "item")

    @tidy
    def judge(batches):
        for batch in batches:
            out = []
            for doc_id, text, item_id, item in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "doc_text", "item_id", "item_text"))):
                out += _judge(doc_id, tokens([text])[0], item_id, tokens([item])[0], least, threshold)
            yield _emit(out)

    return full.select("doc_id", "doc_text", "item_id", "item_text").mapInArrow(judge, LEAKS)


def drop_leaking(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that leak no item; rows with a null doc_id stay."""
    key = unused("__bad", docs.columns)
    bad = leaks(docs, benchmark, **options).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(bad, docs["doc_id"].cast("long") == bad[key], "left_anti")
