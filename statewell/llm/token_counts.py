"""Token counts by greedy longest match in linear time, without building the tokens.

The vocabulary is a trie. Each node has a failure link and the number of tokens that
are popped on the way to it, both precomputed, so a word is scanned once, byte by byte,
with no backing up (the public linear MaxMatch construction).

Words are runs of bytes other than ASCII white space; a word is matched with a blank
before it, as vocabularies of this kind mark word starts. Defined results: a null
text has no words and no tokens; bytes the vocabulary can't match count as one token
for the whole word; other columns pass unchanged; empty tables give no rows.
"""

from __future__ import annotations

import base64
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, unused

#: Distinct words that a worker remembers the counts of.
REMEMBERED = 200_000


def read_vocabulary(path: str) -> list[bytes]:
    """Tokens of a rank file that are no white space within."""
    with open(path, "rb") as f:
        tokens = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    return [t for t in tokens if t and not t.lstrip(b" ").split()[1:] and t.count(b" ") == t.startswith(b" ")]


class Automaton:
    def __init__(self, tokens: list[bytes]) -> None:
        children: list[dict[int, int]] = [{}]
        final = [False]
        for token in tokens:
            node = 0
            for byte in token:
                nxt = children[node].get(byte)
                if nxt is None:
                    nxt = children[node][byte] = len(children)
                    children.append({})
                    final.append(False)
                node = nxt
            final[node] = True
        fail, pops = [-1] * len(children), [0] * len(children)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for byte, v in children[u].items():
                queue.append(v)
                if final[v]:
                    fail[v], pops[v] = 0, 1
                    continue
                z, n = fail[u], pops[u]
                while z >= 0 and byte not in children[z]:
                    n, z = n + pops[z], fail[z]
                if z >= 0:
                    fail[v], pops[v] = children[z][byte], n
        self.children, self.fail, self.pops = children, fail, pops

    def count(self, word: bytes) -> int:
        """Tokens of one word; 1 if it can't be matched."""
        node, n = 0, 0
        children, fail, pops = self.children, self.fail, self.pops
        for byte in word:
            while (nxt := children[node].get(byte)) is None:
                n += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = nxt
        while node > 0:
            n += pops[node]
            node = fail[node]
        return n if node == 0 else 1


class _Counts(dict):
    """Counts of words, worked out when first asked for."""

    def __init__(self, automaton: Automaton) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self[word] = self.automaton.count(b" " + word)
        return n


_BUILT: dict[str, _Counts] = {}


def _counts(path: str) -> _Counts:
    if path not in _BUILT:
        _BUILT[path] = _Counts(Automaton(read_vocabulary(path)))
    return _BUILT[path]


def count_tokens(df: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Columns of ``df`` with n_words and n_tokens. ``vocabulary`` is a rank file's path on every machine."""
    others = [x for x in df.columns if x not in ("n_words", "n_tokens")]

    @tidy
    def run(batches):
        get = _counts(vocabulary).__getitem__
        for batch in batches:
            n_words, n_tokens = [], []
            for value in batch.column(len(others)).to_pylist():
                words = (value or "").encode().split()
                n_words.append(len(words))
                n_tokens.append(sum(map(get, words)))
            columns = [batch.column(x) for x in others] + [pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*others, "n_words", "n_tokens"])

    fields = ", ".join(f"`{x}` {df.schema[x].dataType.simpleString()}" for x in others)
    return df.select(*others, F.col(text).cast("string").alias(unused("__text", df.columns))).mapInArrow(run, f"{fields}, n_words long, n_tokens long")
