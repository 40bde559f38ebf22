"""How the sources of a language differ in their words, from tries that merge.

1. Each task counts the terms of its texts in a trie of their bytes. An end has a counter
   for each (lang, source): occurrences and documents. A trie over its budget is written
   in byte order and begun anew, so partial tries are sorted runs of the shared folder.
2. Ranges of terms merge: a range's partial tries go into one trie, counters add up, and
   its walk in UTF-8 order gives each language's kept terms with a count per source.
3. Each range of a language meets the totals of its groups, and the same walk gives sums
   for pairs of sources and the best terms of each group, at most ``top`` a range.
   Spark adds the sums and ranks both.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import delete, materialize, new_folder, steps, text_buffers, tidy
from .radix import Trie

#: What stands between terms: ASCII other than letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes that may be part of a term.
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Bytes of text that are split at once, and counters that wait to be merged.
STEP, STEP_COUNTERS = 8 << 20, 500_000
#: Counters and bytes of a task's trie beyond which it is written.
BUDGET_COUNTERS, BUDGET_BYTES = 3_000_000, 192 << 20
#: Low bits of a counter's key, which number its group within a task.
GROUP_BITS = 24
#: Partial rows, of a term and language each, that a range gets, about.
RANGE_ROWS = 150_000
#: Numbers of one step of arithmetic on terms and sources.
CELLS = 1 << 19
UNIT = 1_000_000_000

PARTIAL = "lang string, term binary, docs long, sources array<string>, counts array<long>"
PARTIAL_SCHEMA = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
PARTIAL_NAMES = PARTIAL_SCHEMA.names
KEPT = "lang string, range int, term binary, sources array<string>, counts array<long>"


class Counted:
    """A trie of terms whose ends have counters of occurrences and documents for each group.

    An end has a number; counters are sorted arrays of (end, group), so adding many is
    one merge and no step per counter.
    """

    def __init__(self) -> None:
        self.trie, self.groups = Trie(), {}
        self.keys = self.n = self.docs = np.zeros(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def ends(self, terms: list[bytes]) -> np.ndarray:
        """The numbers of the terms' ends; -1 for the empty one."""
        out, end, trie = np.full(len(terms), -1, np.int64), self.trie.end, self.trie
        for i, term in enumerate(terms):
            if term:
                node = end(term)
                if node.value is None:
                    node.value = trie.ends
                    trie.ends += 1
                out[i] = node.value
        return out

    def group(self, names: list) -> np.ndarray:
        return np.array([self.groups.setdefault(x, len(self.groups)) for x in names], np.int64)

    def add(self, ends: np.ndarray, groups: np.ndarray, n: np.ndarray, docs: np.ndarray) -> None:
        real = ends >= 0
        self.new.append((ends[real] << GROUP_BITS | groups[real], n[real], docs[real]))
        self.waiting += int(real.sum())
        if self.waiting > max(len(self.keys), STEP_COUNTERS):
            self.merge()

    def merge(self) -> None:
        columns = [np.concatenate([x, *y]) for x, y in zip((self.keys, self.n, self.docs), zip(*self.new))] if self.new else [self.keys, self.n, self.docs]
        order = np.argsort(columns[0], kind="stable")
        keys, n, docs = (x[order] for x in columns)
        head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        self.keys = keys[head]
        self.n, self.docs = (np.add.reduceat(x, head) if len(head) else x for x in (n, docs))
        self.new, self.waiting = [], 0

    def walk(self) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms in the order of their bytes; and for each counter, in that order: term, group, occurrences, documents."""
        self.merge()
        terms, rank = [], np.zeros(self.trie.ends, np.int64)
        for term, node in self.trie.walk():
            rank[node.value] = len(terms)
            terms.append(term)
        term, group = rank[self.keys >> GROUP_BITS], self.keys & ((1 << GROUP_BITS) - 1)
        order = np.lexsort((group, term))
        return terms, term[order], group[order], self.n[order], self.docs[order]


def lang_rows(found: Counted, least_docs: int = 0):
    """Batches of lang, term, documents, sources and their counts, in the order of terms; of terms in ``least_docs`` or more documents."""
    terms, term, group, n, docs = found.walk()
    if not len(term):
        return
    names = list(found.groups)
    langs = sorted({x for x, _ in names})
    place = {x: i for i, x in enumerate(langs)}
    lang = np.array([place[x] for x, _ in names])[group]
    order = np.lexsort((group, lang, term))  # so that the sources of a term and language stand together
    term, lang, group, n, docs = (x[order] for x in (term, lang, group, n, docs))
    head = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (lang[1:] != lang[:-1])])
    size, docs = np.diff(np.r_[head, len(term)]), np.add.reduceat(docs, head)
    keep = np.flatnonzero(docs >= least_docs)
    words, tongues, sources = pa.array(terms, pa.binary()), pa.array(langs, pa.string()), pa.array([x for _, x in names], pa.string())
    for lo in range(0, len(keep), 50_000):
        some = keep[lo : lo + 50_000]
        first, width = head[some], size[some]
        cuts = np.r_[0, np.cumsum(width)]
        at = np.repeat(first - cuts[:-1], width) + np.arange(cuts[-1])
        offsets = pa.array(cuts.astype(np.int32))
        yield tongues.take(pa.array(lang[first])), words.take(pa.array(term[first])), pa.array(docs[some]), pa.ListArray.from_arrays(offsets, sources.take(pa.array(group[at]))), pa.ListArray.from_arrays(offsets, pa.array(n[at]))


def terms_of(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of some texts, and for each pair that occurs: text, term, occurrences."""
    pieces = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=BETWEEN)
    rows = pc.list_parent_indices(pieces).to_numpy()
    flat = pc.list_flatten(pieces).dictionary_encode()
    words = flat.dictionary.cast(pa.binary()).to_pylist()
    if not words:
        return words, *(np.zeros(0, np.int64) for _ in range(3))
    pairs, n = np.unique(rows.astype(np.int64) * len(words) + flat.indices.to_numpy(), return_counts=True)
    return words, pairs // len(words), pairs % len(words), n


def _pieces(text: bytes, size: int):
    """``text`` in pieces of about ``size`` bytes, cut between terms."""
    lo, data = 0, np.frombuffer(text, np.uint8)
    while lo < len(text):
        hi = min(lo + size, len(text))
        while hi < len(text) and LETTER[data[hi]]:
            ahead = np.flatnonzero(~LETTER[data[hi : hi + size]])
            hi = hi + int(ahead[0]) if len(ahead) else min(hi + size, len(text))
        yield text[lo:hi].decode()
        lo = hi


def count_terms(docs: DataFrame, counters: int = BUDGET_COUNTERS, size: int = BUDGET_BYTES) -> DataFrame:
    """Partial counts of (lang, source, text): a row for each end and language of each trie, in the order of terms.

    The groups of a language that a task meets are a row with a null term besides. Longer texts than a
    step are counted in pieces, and are one document.
    """

    def written(found: Counted):
        by: dict[str, list[str]] = {}
        for lang, source in found.groups:
            by.setdefault(lang, []).append(source)
        if by:
            rows = [{"lang": k, "term": None, "docs": 0, "sources": v, "counts": [0] * len(v)} for k, v in by.items()]
            yield pa.RecordBatch.from_pylist(rows, PARTIAL_SCHEMA)
        for columns in lang_rows(found):
            yield pa.RecordBatch.from_arrays(list(columns), PARTIAL_NAMES)

    def count(found: Counted, part: pa.RecordBatch, long: bool) -> None:
        group = found.group(list(zip(part.column(0).to_pylist(), part.column(1).to_pylist())))
        if not long:
            words, row, term, n = terms_of(part.column(2))
            found.add(found.ends(words)[term], group[row], n, np.ones(len(n), np.int64))
            return
        ends, times = [], []
        for piece in _pieces(part.column(2)[0].as_py().encode(), STEP):
            words, _, term, n = terms_of(pa.array([piece], pa.string()))
            ends.append(found.ends(words)[term])
            times.append(n)
        ends, place = np.unique(np.concatenate(ends), return_inverse=True)
        n = np.zeros(len(ends), np.int64)
        np.add.at(n, place, np.concatenate(times))
        found.add(ends, np.full(len(ends), group[0]), n, np.ones(len(ends), np.int64))

    @tidy
    def run(batches):
        found = Counted()
        for batch in batches:
            _, offsets = text_buffers(batch.column(2))
            for lo, hi in steps(offsets, STEP):
                count(found, batch.slice(lo, hi - lo), offsets[hi] - offsets[lo] > 2 * STEP)
                if len(found.keys) + found.waiting > counters or found.trie.size > size:
                    found.merge()
                    if len(found.keys) > counters // 2 or found.trie.size > size:
                        yield from written(found)
                        found = Counted()
        yield from written(found)

    return docs.mapInArrow(run, PARTIAL)


def merge_ranges(partial: DataFrame, ranges: int, least_docs: int = 3) -> DataFrame:
    """Kept terms of each language, from partial tries that ``ranges`` tasks merge by range of terms."""

    def merged(found: Counted, batches: list) -> None:
        rows = pa.Table.from_batches(batches).combine_chunks()
        lang, term, sources, counts = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (rows[c] for c in ("lang", "term", "sources", "counts")))
        row = pc.list_parent_indices(sources).to_numpy()
        lang, term, source = lang.dictionary_encode(), term.dictionary_encode(), pc.list_flatten(sources).dictionary_encode()
        ends = found.ends(term.dictionary.to_pylist())[term.indices.to_numpy()]
        langs, names = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
        each, place = np.unique(lang.indices.to_numpy().astype(np.int64)[row] * len(names) + source.indices.to_numpy(), return_inverse=True)
        groups = found.group([(langs[x // len(names)], names[x % len(names)]) for x in each.tolist()])[place]
        docs = np.zeros(len(row), np.int64)
        docs[np.flatnonzero(np.r_[True, row[1:] != row[:-1]])] = rows["docs"].to_numpy()  # once for each term and language
        found.add(ends[row], groups, pc.list_flatten(counts).to_numpy(), docs)

    @tidy
    def run(batches):
        found, held, size = Counted(), [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size > STEP_COUNTERS // 4:
                merged(found, held)
                held, size = [], 0
        if held:
            merged(found, held)
        place = TaskContext.get().partitionId()
        for lang, term, _, sources, counts in lang_rows(found, least_docs):
            yield pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(lang), place, np.int32)), term, sources, counts], ["lang", "range", "term", "sources", "counts"])

    return partial.repartitionByRange(ranges, "term").mapInArrow(run, KEPT)


FOUND = "lang string, source string, part string, item string, value long"
FOUND_SCHEMA = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def shares(counts: np.ndarray, total) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / total), exact: by digits where the product needs more than 63 bits."""
    whole, rest = np.divmod(counts + 1, total)
    out = whole
    for _ in range(9):  # long division, a digit of UNIT at a time
        digit, rest = np.divmod(rest * 10, total)
        out = out * 10 + digit
    return out + 1


def _range_sums(least: int):
    """For a range of a language: sums over its terms for its block of sources, and their best terms."""

    def run(key: tuple, groups: pa.Table, terms: pa.Table) -> pa.Table:
        block, blocks = key[2].as_py(), groups["blocks"][0].as_py()
        names = groups["source"].to_pylist()
        order = sorted(range(len(names)), key=lambda i: names[i])
        names = [names[i] for i in order]
        take = lambda x: np.asarray(groups[x].to_numpy(), np.int64)[order]
        kept, n, lang_n = take("kept"), take("n"), take("lang_n")
        lang, size = groups["lang"][0].as_py(), len(names)
        mine = np.arange(block, size, blocks)
        total, all_total, place = n + kept, int(lang_n[0] + kept[0]), {x: i for i, x in enumerate(names)}
        sums = np.zeros((len(mine), size), np.int64)
        best: list[tuple[np.ndarray, list]] = [(np.zeros(0, np.int64), []) for _ in mine]
        width = max(1, CELLS // size)
        terms = terms.sort_by("term")  # by bytes
        for lo in range(0, terms.num_rows, width):
            part = terms.slice(lo, width)
            sources, counts = part["sources"].combine_chunks(), part["counts"].combine_chunks()
            at = pc.list_parent_indices(sources).to_numpy()
            who = pc.list_flatten(sources).dictionary_encode()
            who = np.array([place[x] for x in who.dictionary.to_pylist()], np.int64)[who.indices.to_numpy()]
            c = np.zeros((part.num_rows, size), np.int64)
            c[at, who] = pc.list_flatten(counts).to_numpy()
            p, q = shares(c, total), shares(c.sum(axis=1), all_total)
            for i, s in enumerate(mine):
                d = p[:, s : s + 1] - p
                sums[i] += (d * d // p).sum(axis=0)
                hit = np.flatnonzero((c[:, s] > 0) & (p[:, s] > q))
                if len(hit):
                    d = p[hit, s] - q[hit]
                    value = np.r_[best[i][0], d * d // q[hit]]
                    names_of = [*best[i][1], *part["term"].take(pa.array(hit)).to_pylist()]
                    first = np.argsort(-value, kind="stable")[:least]  # terms come in order, so ties stay in order
                    best[i] = value[first], [names_of[x] for x in first]
        rows = [(names[s], "pair", names[o], v) for i, s in enumerate(mine) for o, v in enumerate(sums[i].tolist()) if o != s]
        rows += [(names[s], "term", t.decode(), v) for i, s in enumerate(mine) for v, t in zip(best[i][0].tolist(), best[i][1])]
        source, what, item, value = zip(*rows) if rows else ((), (), (), ())
        return pa.Table.from_arrays([pa.array(x, t) for x, t in (([lang] * len(rows), pa.string()), (source, pa.string()), (what, pa.string()), (item, pa.string()), (value, pa.int64()))], schema=FOUND_SCHEMA)

    return run


def divergence(docs: DataFrame, least_docs: int = 3, top: int = 200, counters: int = BUDGET_COUNTERS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """lang, source, part, item, value, rank: see the parts below; all arithmetic is exact.

    Of each (lang, source) group and each term that ``least_docs`` documents of the lang
    hold, p = 1 + floor(1e9 * (count + 1) / (N + V)). Part ``pair``: the sum over the lang's kept terms
    of floor((p - q)^2 / q) against the p of each other source. Part ``term``: the same value of one term
    against the p of the lang, for terms of the group with p above it, ranks to ``top``.

    Defined results: null text, lang and source are empty strings; every row is a
    document, also where ids repeat or are null; groups without terms take part with
    counts of 0, a lang of one source has no pairs, a lang without kept terms has pairs
    of value 0; ties rank by item in UTF-8 order; other columns aren't read; an empty
    table gives no rows. Counts of a group must stay below 2**59.
    """
    spark = docs.sparkSession
    folder = new_folder(spark)
    rows = docs.select(*(F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in ("lang", "source", "text")))
    partial = materialize(count_terms(rows, counters), "partial", folder)
    ends = partial.where("term is not null")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(ends.count() / range_rows))
    kept = materialize(merge_ranges(ends, ranges, least_docs), "kept", folder)
    # groups and their totals
    counts = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    groups = partial.where("term is null").select("lang", F.explode("sources").alias("source")).distinct().join(counts, ["lang", "source"], "left")
    groups = materialize(groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")), "groups", folder)
    langs = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count("*").alias("size"))
    langs = langs.join(kept.groupBy("lang").agg(F.count("*").alias("kept")), "lang", "left").select("lang", "lang_n", F.coalesce("kept", F.lit(0)).alias("kept"), F.ceil(F.col("size") * F.col("size") / CELLS).cast("int").alias("blocks"))
    langs = materialize(langs, "langs", folder)
    # each range of a lang, at least one, gets all its groups; sources of a lang with very many are dealt in blocks
    blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    places = kept.select("lang", "range").unionByName(langs.select("lang", F.lit(0).alias("range"))).distinct()
    heads = groups.join(langs, "lang").join(places, "lang").select("*", blocks)
    heads = heads.toDF(*heads.columns)  # columns of its own, as both sides come from the same tables
    bodies = kept.join(langs.select("lang", "blocks"), "lang").select("lang", "range", "term", "sources", "counts", blocks)
    keys = ["lang", "range", "block"]
    found = heads.groupBy(*keys).cogroup(bodies.groupBy(*keys)).applyInArrow(_range_sums(top), FOUND)
    found = materialize(found, "found", folder)
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    best = found.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)
    out = materialize(pairs.withColumn("rank", rank).unionByName(best), "divergence")
    delete(spark, folder)
    return out
