"""Repeated windows against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from statewell.llm.common import word_values, words_of
from statewell.llm.queries import op1_substring_dedup, op5_suffix_dedup
from statewell.llm.substring_dedup import FingerprintIndex, dedup_substrings, merge_join_settings
from statewell.llm.suffix_dedup import dedup_bytes
from statewell.llm.windows import long_text_phrases


def brute(docs, window, split):
    """doc_id -> (units, which are covered by a window that starts earlier)."""
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda r: r[0]):
        units = split((text or "").encode())
        gone = [False] * len(units)
        for s in range(len(units) - window + 1):
            key = tuple(units[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        out[doc] = (units, gone)
    return out


def words_result(docs, window):
    out = {}
    for doc, (units, gone) in brute(docs, window, bytes.split).items():
        kept = b" ".join(u for u, g in zip(units, gone) if not g)
        out[doc] = (len(units), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def bytes_result(docs, window):
    out = {}
    for doc, (units, gone) in brute(docs, window, bytes).items():
        runs = sum(g and not h for g, h in zip(gone, [False, *gone]))
        out[doc] = (len(units), sum(gone), runs, bytes(u for u, g in zip(units, gone) if not g))
    return out


def hard_docs(seed=1):
    r = random.Random(seed)
    words = ["ab", "ç", "dé", "x", "the", "of", "longer", "ﬁn"]
    base = [" ".join(r.choice(words) for _ in range(60)) for _ in range(4)]
    docs = []
    for i in range(60):
        kind = r.randrange(8)
        text = r.choice(base)
        if kind == 0:
            text = None if i % 2 else ""
        elif kind == 1:
            w = text.split()
            w[r.randrange(60)] = f"new{i}"
            text = " ".join(w)
        elif kind == 2:
            text = text[r.randrange(50) :] + "\n\t" + r.choice(base)[: r.randrange(400)]
        elif kind == 3:
            text = "a " * r.randrange(5, 200)
        elif kind == 4:
            text = "\x00" * r.randrange(250)
        elif kind == 5:
            text = " ".join(f"w{r.randrange(10**6)}" for _ in range(r.randrange(100)))
        docs.append((i * 3, text))
    return docs


def test_words_against_brute_force(spark):
    docs = hard_docs()
    df = spark.createDataFrame([(d, t, "x", 7) for d, t in docs], "doc_id long, text string, n_words string, p int")
    for batches in (1, 3):
        got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in dedup_substrings(df, batches=batches).collect()}
        assert got == words_result(docs, 20)


def test_bytes_against_brute_force(spark):
    docs = hard_docs(2)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, kept string")
    for hot in (20_000, 2):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in dedup_bytes(df, hot=hot).collect()}
        assert got == bytes_result(docs, 100)


def test_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op1_substring_dedup(spark, sf).collect()}
    assert got == words_result(docs, 20)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op5_suffix_dedup(spark, sf).collect()}
    assert got == {k: (*v[:3], hashlib.sha256(v[3]).hexdigest()) for k, v in bytes_result(docs, 100).items()}


@pytest.mark.parametrize("dedup", [dedup_substrings, dedup_bytes])
def test_odd_rows(spark, dedup):
    schema = "doc_id long, text string"
    assert dedup(spark.createDataFrame([], schema)).count() == 0
    text = " ".join(f"v{i}" for i in range(80))
    rows = [(None, text), (5, text), (5, text), (6, text), (7, None)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed > 0) for r in dedup(spark.createDataFrame(rows, schema)).collect())
    assert got == [(False, 5, False), (False, 5, False), (False, 6, True), (False, 7, False), (True, 0, False)]


def test_runs_are_merged_and_outlive_the_session(spark, tmp_path):
    text = [" ".join(f"v{i}_{j}" for j in range(40)) for i in range(5)]
    df = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    folder = f"file://{tmp_path}/index"
    index = FingerprintIndex(spark, fanout=1, folder=folder)
    for i in range(4):
        assert index.add(df.where(f"doc_id = {i}"), df).count() == 0
    assert len(index.runs) == 1
    again = spark.createDataFrame([(9, text[2]), (10, text[4]), (11, text[4][: len(text[4]) // 2] + " " + text[1])], "doc_id long, text string")
    other = spark.newSession()
    for run, _ in index.runs:
        spark.sql(f"DROP TABLE {run}")
    reopened = FingerprintIndex(other, fanout=2, folder=folder)
    assert reopened.runs == index.runs
    got = {r.doc_id for r in reopened.add(*(other.createDataFrame(x.collect(), x.schema) for x in (again, df.unionByName(again)))).collect()}
    assert got == {9, 11}
    assert len(FingerprintIndex(other, folder=folder).runs) == 2


def test_history_is_not_shuffled(spark, tmp_path):
    rows = [(i, " ".join(f"v{i}_{j}" for j in range(300))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = FingerprintIndex(spark, fanout=2, folder=f"file://{tmp_path}/index")
    index.add(df.where("doc_id < 20"), df)
    index.add(df.where("doc_id >= 20"), df)
    with merge_join_settings(spark):
        plan = index.merged(index.runs.pop()[0])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Bucketed: true" in plan
    assert not re.search(r"Sort \[p#\w+ ASC NULLS FIRST, u#", plan)  # a bucket is one sorted file


@pytest.mark.parametrize("unit, window, k", [("word", 20, 5), ("byte", 100, 36)])
def test_phrases_of_a_long_text(monkeypatch, unit, window, k):
    """Cut at any place, all windows are in a phrase, and periodic text has few."""
    r = random.Random(3)
    for text in (b"a" * 50_000, b"ab " * 20_000, bytes(r.choice(b"abcdefgh ") for _ in range(50_000))):
        data = np.frombuffer(text, np.uint8)
        n = len(data) if unit == "byte" else len(text.split())
        found = list(long_text_phrases(data, unit, window, k, size=3000))
        places = [x for at, *_ in found for x in at.tolist()]
        windows = [s for x in places for s in range(x >> 7, (x >> 7) + (x & 127) + 1)]
        assert windows == list(range(max(n - window + 1, 0)))
        if len(set(text.split() if unit == "word" else text)) <= 3:
            assert len(places) <= len(windows) / 60 + 3 * 20


@pytest.mark.parametrize("dedup", [dedup_substrings, dedup_bytes])
def test_clashing_columns_pass(spark, dedup):
    text = " ".join(f"v{i}" for i in range(80))
    df = spark.createDataFrame([(1, text, 1, 2, 3), (2, text, 4, 5, 6)], "doc_id long, text string, __id long, __TEXT long, __spans long")
    got = sorted(tuple(r)[:4] + (r.n_removed > 0,) for r in dedup(df).collect())
    assert got == [(1, 1, 2, 3, False), (2, 4, 5, 6, True)]


def thue_morse(n: int, a: str = "a", b: str = "b") -> str:
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_words_of_two_letters_in_a_pattern_are_told_apart(spark):
    """Polynomials modulo 2**64 give a Thue-Morse word and its complement one value, whatever their base."""
    n = 1 << 11
    one, other = thue_morse(n), thue_morse(n, "b", "a")
    rest = [f"v{i}" for i in range(19)]
    docs = [(1, " ".join([*rest, one])), (2, " ".join([*rest, other])), (3, " ".join([*rest, one]))]
    # the same pattern of two words, and short words of the letters
    docs += [(4, " ".join(thue_morse(n))), (5, " ".join(thue_morse(n, "b", "a"))), (6, " ".join(thue_morse(32) + x for x in "pq") + " " + " ".join(rest))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in dedup_substrings(df).collect()}
    assert got == words_result(docs, 20) and got[2][1] == 0 and got[3][1] == 20
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in dedup_bytes(df).collect()}
    assert got == bytes_result(docs, 100)


@pytest.mark.parametrize("size", [1, 8, 9, 64, 65, 128, 1024])
def test_values_of_words(size):
    words = [thue_morse(size), thue_morse(size, "b", "a"), "a" * size, "a" * (size - 1) + "b", "b" + "a" * (size - 1)]
    raw = " ".join(words + words).encode()
    data = np.frombuffer(raw, np.uint8)
    s, e, _ = words_of(data, np.array([0, len(data)]))
    values = word_values(data, s, e).tolist()
    assert values[: len(words)] == values[len(words) :]
    assert len(set(values)) == len(set(words))


def test_runs_shrink_geometrically(spark, tmp_path):
    rows = [(i, " ".join(f"v{i}_{j}" for j in range(60))) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = FingerprintIndex(spark, folder=f"file://{tmp_path}/index")
    for i in range(9):
        assert index.add(df.where(f"doc_id = {i}"), df).count() == 0
    sizes = [n for _, n in index.runs]
    assert all(a > 2 * b for a, b in zip(sizes, sizes[1:])) and len(sizes) <= 4
    again = spark.createDataFrame([(20, rows[0][1]), (21, rows[8][1]), (22, "new " * 3)], df.schema)
    assert {r.doc_id for r in index.add(again, df.unionByName(again)).collect()} == {20, 21}
