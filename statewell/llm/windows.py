"""Which fixed-length windows of a corpus also start earlier, exactly.

Units are words or bytes. In each window the k-gram with the least hash is its
trigger; equal windows have equal triggers at equal offsets. Neighbouring windows
with one trigger form a phrase: what they cover together. So

1. each phrase is one row ``(p, u, doc_id, at)``: hash of the trigger, hash of the
   phrase, first window and number of windows. There are about ``2 / (window - k)``
   rows a unit in prose and one in 128 units of periodic text, not one a window, and one
   shuffle on ``p`` finds equal phrases. A long text is worked on in steps;
2. a phrase that stands earlier makes all its windows repeats. Where a trigger has
   several phrases (matches end there), or stands twice in one, windows are compared
   one by one;
3. windows found in 1 and 2 are joined to their documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BYTE_VALUES, STEP_BYTES, U64, long_text_words, mix, prefix_sums, span_hash, steps, text_buffers, tidy, unused, word_values, words_of

PHRASES = "doc_id long, at long, p long, u long, own boolean, known boolean"
WINDOWS = "doc_id long, at long, h1 long, h2 long"
#: ``at`` holds the first window and, in the low bits, the number of windows less one.
SHIFT, LOW = 7, 127


def phrases(units: np.ndarray, offsets: np.ndarray, window: int, k: int):
    """Row, packed place, trigger hash, phrase hash of each phrase, and whether it may repeat itself.

    ``units`` are bytes or 64-bit values of words. The phrase hash is xxh3 of all its units.
    """
    values = BYTE_VALUES[units] if units.dtype == np.uint8 else units
    n, wide = len(values), window - k + 1
    whole = np.flatnonzero(np.diff(offsets) >= window)
    if not len(whole):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    sums = prefix_sums(values)
    at = np.arange(n - k + 1)
    grams = mix(span_hash(sums, at, at + k))
    least = (grams & U64(0xFFFFFFFF00000000)) | at.astype(U64)
    count, span = n - window + 1, 1
    while span * 2 <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:count], least[wide - span : wide - span + count])
    place = (least & U64(0xFFFFFFFF)).astype(np.int64)
    mark = np.zeros(count + 1, np.int8)
    mark[offsets[whole]] += 1
    mark[offsets[whole + 1] - window + 1] -= 1
    starts = np.flatnonzero(np.cumsum(mark[:-1], dtype=np.int8))
    place = place[starts]
    trigger = grams[place]
    new = np.ones(len(starts), bool)
    # equal triggers at different places make one phrase, so periodic texts have few
    new[1:] = (trigger[1:] != trigger[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.arange(len(starts))
    new |= (at - np.maximum.accumulate(np.where(new, at, 0))) % (LOW + 1) == 0
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(starts)] - 1
    lo, hi = starts[first], starts[last]
    raw, size = memoryview(np.ascontiguousarray(units)).cast("B"), units.itemsize
    u = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip((lo * size).tolist(), ((hi + window) * size).tolist())), U64, len(lo))
    row = np.searchsorted(offsets, lo, "right") - 1
    return row, (lo - offsets[row]) << SHIFT | (hi - lo), trigger[first].view(np.int64), u.view(np.int64), place[first] != place[last]


def long_text_phrases(data: np.ndarray, unit: str, window: int, k: int, size: int = STEP_BYTES):
    """Packed places, trigger and phrase hashes of one text, ``size`` units at a time.

    Where the text is cut a phrase is too, which costs a comparison and no match.
    """
    units = long_text_words(data) if unit == "word" else data
    for lo in range(0, max(len(units) - window + 1, 0), size):
        part = units[lo : lo + size + window - 1]
        _, at, p, u, own = phrases(part, np.array([0, len(part)]), window, k)
        yield at + (lo << SHIFT), p, u, own


def later_here(doc: np.ndarray, at: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Which rows have an equal phrase (p, u) at an earlier place among these rows."""
    order = np.lexsort((at, doc, u, p))
    doc, at, p, u = doc[order], at[order], p[order], u[order]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (u[1:] != u[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))
    out = np.empty(len(p), bool)
    out[order] = (doc != doc[head]) | (at != at[head])
    return out


def phrase_table(docs: DataFrame, unit: str, window: int, k: int) -> DataFrame:
    """The phrases of every whole text: doc_id, at, p, u, own and known.

    ``own`` says that the trigger stands twice in the phrase, so windows of it may be
    equal. ``known`` says that a batch of rows has the phrase earlier. Such rows need no
    comparison and have no p and u (0), so that a phrase in very many places meets as
    one row a batch.
    """
    if not 0 < window - k <= LOW:
        raise ValueError(f"window - k must be 1 to {LOW}")

    def rows(doc, at, p, u, own):
        known = later_here(doc, at, p, u)
        p[known] = u[known] = 0
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, at, p, u, own.astype(bool), known)], ["doc_id", "at", "p", "u", "own", "known"])

    @tidy
    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            found = []
            for i, j in steps(offsets):
                part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                if len(part) > 2 * STEP_BYTES:  # one long text
                    for at, p, u, own in long_text_phrases(part, unit, window, k):
                        yield rows(np.full(len(at), ids[i]), at, p, u, own)
                    continue
                if unit == "word":
                    s, e, _ = words_of(part, off)
                    part, off = word_values(part, s, e), np.searchsorted(s, off)
                row, at, p, u, own = phrases(part, off, window, k)
                found.append((ids[i:j][row], at, p, u, own))
            if found:
                yield rows(*(np.concatenate(x) for x in zip(*found)))

    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PHRASES)


def unclear(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Texts with the phrases (array ``unclear`` of at, age and more) whose windows must be compared."""
    fields = [x for x in places.columns if x != "doc_id"]
    per = places.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(F.struct(*fields)).alias("unclear"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(per.hint("shuffle_hash"), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "unclear")


def window_rows(found: DataFrame, unit: str, window: int) -> DataFrame:
    """A row with a 128-bit digest of its own words or bytes for each unclear window."""

    @tidy
    def run(batches):
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], []]
            for doc, text, places in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "text", "unclear"))):
                raw = text.encode()
                words = raw.split() if unit == "word" else raw
                done = set()
                for place in places:
                    lo = place["at"] >> SHIFT
                    for s in range(lo, lo + (place["at"] & LOW) + 1):
                        if (s, place["age"]) in done:
                            continue
                        done.add((s, place["age"]))
                        piece = words[s : s + window]
                        h = xxhash.xxh3_128_intdigest(b" ".join(piece) if unit == "word" else piece)
                        for x, v in zip(out, (doc, s << SHIFT, place["age"], (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63))):
                            x.append(v)
                if len(out[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "at", "age", "h1", "h2"])
                    out = [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "at", "age", "h1", "h2"])

    return found.mapInArrow(run, "doc_id long, at long, age long, h1 long, h2 long")


def repeated_windows(rows: DataFrame) -> DataFrame:
    """doc_id, at, age of the windows of ``rows`` that stand earlier in it.

    Counts are summed before the shuffle, so one window in very many documents
    meets as one row a task; AQE splits the join's large keys.
    """
    key = F.struct("age", "doc_id", "at")
    first = rows.groupBy("h1", "h2").agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(first, ["h1", "h2"]).where(key > F.col("first")).select("doc_id", "at", "age")


def with_spans(docs: DataFrame, spans: DataFrame, name: str) -> DataFrame:
    """``docs`` and an array ``name`` of the packed places that repeat."""
    own = unused("__id", docs.columns)
    per = spans.groupBy(F.col("doc_id").alias(own)).agg(F.collect_list("at").alias(name))
    return docs.join(per.hint("shuffle_hash"), docs["doc_id"].cast("long") == per[own], "left").drop(own)


def strip_rows(docs: DataFrame, found: DataFrame, strip, new: str) -> DataFrame:
    """Columns of ``docs`` but text and those of ``new``, then what ``strip`` makes of text and places.

    ``strip(texts, places)`` returns Arrow arrays for the columns ``new`` declares.
    """
    made = [x.split()[0] for x in new.split(", ")]
    others = [x for x in docs.columns if x not in ("text", *made)]
    text = unused("__text", docs.columns)
    spans = unused("__spans", [*docs.columns, text])

    @tidy
    def run(batches):
        for batch in batches:
            columns = strip(batch.column(len(others)).to_pylist(), batch.column(len(others) + 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], *columns], [*others, *made])

    schema = ", ".join([*(f"`{x}` {docs.schema[x].dataType.simpleString()}" for x in others), new])
    full = with_spans(docs.select(*others, F.col("text").cast("string").alias(text)), found, spans)
    return full.select(*others, text, spans).mapInArrow(run, schema)


def covered(places: list[int] | None, window: int, n: int) -> np.ndarray | None:
    """Which of ``n`` units the windows at ``places`` cover; None for none."""
    if not places or n == 0:
        return None
    at = np.asarray(places, np.int64)
    lo = at >> SHIFT
    hi = np.minimum(lo + (at & LOW) + window, n)
    step = np.bincount(np.minimum(lo, n), minlength=n + 1) - np.bincount(hi, minlength=n + 1)
    return np.cumsum(step[:n]) > 0
