"""Byte-level BPE by recursive queries, one small database a task.

Each task cuts its texts by the pattern and keeps the pieces it has not met. Their
bytes are rows (word, pos, tok) of a DuckDB relation, and the ranks a table of merges
(a, b, rank). These rows are joined with the merges and aggregated in order; a recursive
query then contracts each word's leftmost pair of the least rank and joins the two new
pairs beside it with the merges; a word without a pair leaves the recursion. A text's
ids are those of its pieces. A query takes ``SLICE`` new pieces at most, also of one text, and its
database has no folder to spill to.

Decoding joins all ids (text, pos, tok) with the vocabulary's bytes and aggregates them
in order.

Pieces longer than ``LONG`` bytes (white space or symbols without end) are merged by
the same rule with a heap, as a recursion would take a step for each merge.

Defined results: a null text is empty and has no ids; ids that the vocabulary lacks
raise an error; repeated rows are encoded each; other columns pass unchanged; empty
tables give no rows.
"""

from __future__ import annotations

import base64
import heapq

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps, tidy, unused

LONG = 64
#: Pieces that a worker remembers the ids of; beyond that it keeps those in use.
REMEMBERED = 400_000
#: Bytes of text, or of ids, that are worked on at once.
BLOCK = 2 << 20
#: New pieces, or ids to decode, in one query; a longer text takes several.
SLICE = 50_000
#: Pieces that are looked up at once among those remembered.
LOOK = 400_000
#: Unicode's white space, which is what \s stands for in the pattern.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

NEVER = 2147483647
CONTRACT = f"""
WITH RECURSIVE live(word, toks, ranks) AS (
    SELECT word, list(tok ORDER BY pos), list(coalesce(rank, {NEVER}) ORDER BY pos)
    FROM cut LEFT JOIN merges ON a = tok AND b = behind GROUP BY word
    UNION ALL
    SELECT word,
           list_concat(list_append(toks[:i - 1], best), toks[i + 2:]),
           list_concat(list_append(CASE WHEN i > 1 THEN list_append(ranks[:i - 2], coalesce(l.rank, {NEVER})) ELSE [] END, coalesce(r.rank, {NEVER})), ranks[i + 2:])
    FROM (SELECT *, list_position(ranks, best) AS i FROM (SELECT *, list_min(ranks) AS best FROM live) WHERE best < {NEVER}) AS word
    LEFT JOIN merges l ON l.a = CASE WHEN i > 1 THEN toks[i - 1] END AND l.b = best
    LEFT JOIN merges r ON r.a = best AND r.b = toks[i + 2]
)
SELECT toks AS ids FROM live WHERE list_min(ranks) = {NEVER} ORDER BY word
"""

DECODE = """
SELECT text, string_agg(bytes, '' ORDER BY pos) AS bytes FROM ids JOIN vocabulary USING (tok) GROUP BY text
"""


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of ``piece``: the leftmost pair of the least rank is merged, again and again."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    n = len(parts)
    left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, token = heapq.heappop(heap)
        j = right[i]
        if not alive[i] or j >= n or parts[i] + parts[j] != token:
            continue
        parts[i], alive[j], right[i] = token, False, right[j]
        if right[i] < n:
            left[right[i]] = i
        for k in (left[i], i):
            if k >= 0 and right[k] < n:
                both = parts[k] + parts[right[k]]
                if both in ranks:
                    heapq.heappush(heap, (ranks[both], k, both))
    return [ranks[p] for p, a in zip(parts, alive) if a]


class Codec:
    """A worker's database with merges and vocabulary, and what it has encoded and decoded."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern.replace(r"[^\s", "[^" + WHITE).replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]"))
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.valid = np.zeros(max(self.ranks.values()) + 1, bool)
        self.valid[list(self.ranks.values())] = True
        pairs = [(x, y, r) for t, r in self.ranks.items() for i in range(1, len(t)) if (x := self.ranks.get(t[:i])) is not None and (y := self.ranks.get(t[i:])) is not None]
        self.tables = {
            "merges": pa.table(dict(zip(("a", "b", "rank"), (pa.array(x, pa.int32()) for x in zip(*pairs))))),
            "vocabulary": pa.table({"tok": pa.array(self.ranks.values(), pa.int32()), "bytes": [t.decode("latin-1") for t in self.ranks]}),
        }
        self.db = None
        self.known, self.lists = pa.array([], pa.string()), pa.array([], pa.list_(pa.int32()))

    def open(self) -> None:
        """A database with the merges and the vocabulary, unless there is one."""
        if self.db is None:
            self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "128MB", "temp_directory": ""})
            for name, table in self.tables.items():
                self.db.register("given", table)
                self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
                self.db.unregister("given")

    def close(self) -> None:
        if self.db is not None:
            self.db.close()
            self.db = None

    def ask_columns(self, query: str, name: str, table: pa.Table) -> list[list]:
        self.open()
        self.db.register(name, table)
        out = self.db.sql(query).to_arrow_table()
        self.db.unregister(name)
        return [x.to_pylist() for x in out.columns]

    def ask(self, query: str, name: str, table: pa.Table) -> pa.ChunkedArray:
        self.open()
        self.db.register(name, table)
        out = self.db.sql(query).to_arrow_table().column(0)
        self.db.unregister(name)
        return out

    def learn(self, new: list[str]) -> tuple[pa.Array, pa.Array]:
        """The pieces of ``new`` in an order of its own, and their ids."""
        whole, long, words = [], [], []
        for piece in new:
            raw = piece.encode()
            (whole if raw in self.ranks else long if len(raw) > LONG else words).append((piece, raw))
        names = pa.array([p for group in (whole, long, words) for p, _ in group], pa.string())
        ids = [pa.array([[self.ranks[raw]] for _, raw in whole] + [merge_long(raw, self.ranks) for _, raw in long], pa.list_(pa.int32()))]
        if words:
            size = np.array([len(raw) for _, raw in words])
            word = np.repeat(np.arange(len(words), dtype=np.int32), size)
            pos = (np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
            tok = self.byte_id[np.frombuffer(b"".join(raw for _, raw in words), np.uint8)]
            behind = np.r_[tok[1:], -1].astype(np.int32)
            behind[np.cumsum(size) - 1] = -1
            found = self.ask(CONTRACT, "cut", pa.table({"word": word, "pos": pos, "tok": tok, "behind": behind}))
            ids += [x.cast(pa.list_(pa.int32())) for x in found.chunks]
        return names, pa.concat_arrays(ids)

    def look_up(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``pieces`` in a row, and how many each has."""
        pieces = pieces.dictionary_encode()
        place = pc.index_in(pieces.dictionary, value_set=self.known).fill_null(-1).to_numpy().copy()
        new = place < 0
        if len(self.known) + new.sum() > REMEMBERED:  # keeps what these pieces have
            self.known, self.lists = self.known.take(place[~new]), self.lists.take(place[~new])
            place[~new] = np.arange(len(self.known))
        if new.any():
            unknown = pieces.dictionary.filter(pa.array(new))
            learnt = [self.learn(unknown[i : i + SLICE].to_pylist()) for i in range(0, len(unknown), SLICE)]
            names, ids = (pa.concat_arrays(x) for x in zip(*learnt))
            place[new] = len(self.known) + pc.index_in(unknown, value_set=names).to_numpy()
            self.known, self.lists = pa.concat_arrays([self.known, names]), pa.concat_arrays([self.lists, ids])
        lists = self.lists.take(place[pieces.indices.to_numpy()])
        return pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype("<i4"), pc.list_value_length(lists).to_numpy(zero_copy_only=False)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and len + 1 bounds of each text's."""
        count, flat, size = [], [np.zeros(0, "<i4")], [np.zeros(0, np.int64)]
        held: list[pa.Array] = []

        def flush():
            ids, each = self.look_up(pa.concat_arrays(held))
            flat.append(ids)
            size.append(each.astype(np.int64))
            held.clear()

        for text in texts:
            pieces = self.pattern.findall(text)
            count.append(len(pieces))
            for i in range(0, len(pieces), LOOK):
                held.append(pa.array(pieces[i : i + LOOK], pa.string()))
                if sum(map(len, held)) >= LOOK:
                    flush()
        if held:
            flush()
        ends = np.r_[0, np.cumsum(np.concatenate(size))]
        return np.concatenate(flat), ends[np.r_[0, np.cumsum(count, dtype=np.int64)]]

    def decode(self, ids: np.ndarray, bound: np.ndarray) -> list[bytes]:
        """The bytes of the ids between each two bounds."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.valid) or not self.valid[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        out: list[list[str]] = [[] for _ in bound[1:]]
        text = np.repeat(np.arange(len(out), dtype=np.int32), np.diff(bound))
        for i in range(0, len(ids), SLICE):
            part = ids[i : i + SLICE]
            table = pa.table({"text": text[i : i + SLICE], "pos": np.arange(len(part), dtype=np.int32), "tok": part})
            for row, joined in zip(*self.ask_columns(DECODE, "ids", table)):
                out[row].append(joined)
        return ["".join(x).encode("latin-1") for x in out]


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _schema(df: DataFrame, others: list[str], new: str) -> str:
    return ", ".join([*(f"`{x}` {df.schema[x].dataType.simpleString()}" for x in others), new])


def _steps(column: pa.Array):
    size = pc.binary_length(column).to_numpy(zero_copy_only=False)
    return steps(np.r_[0, np.cumsum(size)], BLOCK)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """Columns of ``df`` but ``text``, with n_tokens and ids (binary, little-endian 32-bit).

    ``path`` is a rank file at the same place on every machine. With ``decoded`` there is
    also what the ids decode to (binary), made in the same pass.
    """
    new = ["n_tokens", "ids", "decoded"][: 2 + decoded]
    others = [x for x in df.columns if x not in (*new, text)]

    @tidy
    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            texts = batch.column(len(others)).fill_null("")
            for i, j in _steps(texts):
                ids, bound = own.encode(texts[i:j].to_pylist())
                raw = memoryview(ids.tobytes())
                columns = [pa.array(np.diff(bound)), pa.array([raw[a * 4 : b * 4] for a, b in zip(bound[:-1].tolist(), bound[1:].tolist())], pa.binary())]
                if decoded:
                    columns.append(pa.array(own.decode(ids, bound), pa.binary()))
                yield pa.RecordBatch.from_arrays([*(batch.column(x)[i:j] for x in others), *columns], [*others, *new])
                pa.default_memory_pool().release_unused()
        own.close()

    schema = _schema(df, others, "n_tokens long, ids binary" + ", decoded binary" * decoded)
    return df.select(*others, F.col(text).cast("string").alias(unused("__text", df.columns))).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Columns of ``df`` with decoded (binary), the bytes of ``ids``; null ids are none."""
    others = [x for x in df.columns if x != "decoded"]

    @tidy
    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            column = batch.column(others.index(ids)).fill_null(b"")
            for i, j in _steps(column):
                raw = column[i:j].to_pylist()
                bound = np.r_[0, np.cumsum([len(x) // 4 for x in raw])]
                out = pa.array(own.decode(np.frombuffer(b"".join(raw), "<i4"), bound), pa.binary())
                yield pa.RecordBatch.from_arrays([*(x[i:j] for x in batch.columns), out], [*others, "decoded"])
        own.close()

    return df.select(*others).mapInArrow(run, _schema(df, others, "decoded binary"))
