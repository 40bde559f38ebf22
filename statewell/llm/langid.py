"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram is bound from its letters: the
first permuted (rolled) twice, the second once, the third not, multiplied. Texts and
languages are bundles (sums) of their trigrams. A document gets the language whose
prototype has the largest cosine to its bundle; the score is that cosine, 0 at least.

Letters are lower-cased; a-z have vectors of their own, others share the remaining
``SLOTS`` by code point; what is not a letter is one boundary symbol.

Defined results: a null text or one with no letter is ``und`` with score 0; of tied
languages the first in order; rows with null lang are never learned from; if nothing
can be learned, all is ``und``; other columns pass unchanged; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import steps, tidy, unused

DIM, SLOTS, SEED = 512, 64, 7
_CACHE: dict = {}


def slots() -> np.ndarray:
    """The slot of each code point; 0 for what is not a letter."""
    if "slots" not in _CACHE:
        table = np.zeros(0x110000, np.uint8)
        letters = np.array([i for i in range(0x110000) if chr(i).isalpha()])
        table[letters] = 27 + letters % (SLOTS - 27)
        table[ord("a") : ord("z") + 1] = np.arange(1, 27)
        _CACHE["slots"] = table
    return _CACHE["slots"]


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    """Rows of +1 and -1 for trigram ``codes``; bound once a process each."""
    if "place" not in _CACHE:
        letters = np.random.default_rng(SEED).integers(0, 2, (SLOTS, DIM)).astype(np.int8) * 2 - 1
        _CACHE["parts"] = [np.roll(letters, 2, 1), np.roll(letters, 1, 1), letters]
        _CACHE["place"] = np.full(SLOTS**3, -1, np.int32)
        _CACHE["bound"], _CACHE["used"] = np.empty((1 << 12, DIM), np.int8), 0
    place = _CACHE["place"]
    new = codes[place[codes] < 0]
    if len(new):
        new, n = np.unique(new), _CACHE["used"]
        if n + len(new) > len(_CACHE["bound"]):
            grown = np.empty((2 * (n + len(new)), DIM), np.int8)
            grown[:n] = _CACHE["bound"][:n]
            _CACHE["bound"] = grown
        a, b, c = _CACHE["parts"]
        _CACHE["bound"][n : n + len(new)] = a[new // SLOTS**2] * b[new // SLOTS % SLOTS] * c[new % SLOTS]
        place[new] = np.arange(n, n + len(new))
        _CACHE["used"] = n + len(new)
    return _CACHE["bound"][place[codes]]


def counts(texts: list[str | None]):
    """Row bounds, codes and numbers of the trigrams of each text."""
    low = [(x or "").lower() for x in texts]
    size = np.array([len(x) for x in low])
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    # each text between boundary symbols, runs of boundaries as one
    row = np.repeat(np.arange(len(low)), size + 2)
    symbol = np.zeros(len(points) + 2 * len(low), np.uint8)
    inner = np.ones(len(symbol), bool)
    start = np.cumsum(size + 2) - size - 2
    inner[start] = inner[start + size + 1] = False
    symbol[inner] = slots()[points]
    keep = np.ones(len(symbol), bool)
    keep[1:] = (symbol[1:] > 0) | (symbol[:-1] > 0) | (row[1:] != row[:-1])
    symbol, row = symbol[keep].astype(np.int64), row[keep]
    if len(symbol) < 3:
        return np.zeros(len(low) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    code = (symbol[:-2] * SLOTS + symbol[1:-1]) * SLOTS + symbol[2:]
    same = (row[:-2] == row[2:]) & (symbol[1:-1] > 0)
    key = (row[:-2][same] << 18 | code[same]).astype(np.uint64)
    key, n = np.unique(key, return_counts=True)
    row = (key >> np.uint64(18)).astype(np.int64)
    return np.searchsorted(row, np.arange(len(low) + 1)), (key & np.uint64(0x3FFFF)).astype(np.int64), n.astype(np.float32)


def _blocks(texts: list[str | None], size: int = 1 << 19):
    ends = np.r_[0, np.cumsum([len(x or "") for x in texts])]
    yield from steps(ends, size)


def prototypes(docs: DataFrame, lang: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages and their bundles. Each task sends one vector a language; languages are few."""

    @tidy
    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for i, j in _blocks(texts):
                bound, code, n = counts(texts[i:j])
                owner = np.repeat(np.arange(j - i), np.diff(bound))
                for name in set(langs[i:j]):
                    mine = np.array([x == name for x in langs[i:j]])[owner]
                    sums.setdefault(name, np.zeros(SLOTS**3, np.float64))
                    sums[name] += np.bincount(code[mine], n[mine], SLOTS**3)
        for name, total in sums.items():
            used = np.flatnonzero(total)
            vector = np.zeros(DIM)
            for i in range(0, len(used), 4096):
                vector += total[used[i : i + 4096]] @ trigram_vectors(used[i : i + 4096]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([name] * DIM), pa.array(np.arange(DIM)), pa.array(vector)], ["lang", "dim", "v"])

    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    # whole numbers, so that the sum doesn't depend on the order of tasks
    sums = known.mapInArrow(run, "lang string, dim long, v double").groupBy("lang", "dim").agg(F.sum("v").alias("v"))
    found: dict[str, np.ndarray] = {}
    for r in sums.collect():
        found.setdefault(r.lang, np.zeros(DIM))[r.dim] = r.v
    names = sorted(found)
    rows = [found[x] / (np.linalg.norm(found[x]) or 1) for x in names]
    return names, np.array(rows, np.float32).reshape(len(names), DIM)


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """Columns of ``df`` with lang_pred and score."""
    names, rows = model
    others = [x for x in df.columns if x not in ("lang_pred", "score")]

    @tidy
    def run(batches):
        for batch in batches:
            texts = batch.column(len(others)).to_pylist()
            best, score = [], []
            for i, j in _blocks(texts):
                bound, code, n = counts(texts[i:j])
                for a, b in zip(bound[:-1].tolist(), bound[1:].tolist()):
                    if a == b or not names:
                        best.append("und")
                        score.append(0.0)
                        continue
                    vector = n[a:b] @ trigram_vectors(code[a:b]).astype(np.float32)
                    cosine = rows @ (vector / (float(np.linalg.norm(vector)) or 1.0))
                    k = int(cosine.argmax())
                    best.append(names[k])
                    score.append(min(1.0, max(0.0, float(cosine[k]))))
            columns = [batch.column(x) for x in others] + [pa.array(best, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*others, "lang_pred", "score"])

    fields = ", ".join(f"`{x}` {df.schema[x].dataType.simpleString()}" for x in others)
    return df.select(*others, F.col(text).cast("string").alias(unused("__text", df.columns))).mapInArrow(run, f"{fields}, lang_pred string, score double")


def has_letter(text: str) -> Column:
    """Whether the text has a letter; without one no language is predicted."""
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; such rows are not learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
