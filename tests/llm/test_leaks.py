import random
import re

import numpy as np

from statewell.llm.decontamination import drop_leaking, leaks, tile
from statewell.llm.queries import op8_decontamination

from . import brute


def words(text):
    return re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", (text or "").lower())


def plain(docs, items, least, threshold):
    out = set()
    for doc, text in docs:
        for item, passage in items:
            a, b = words(passage), words(text)
            if a and not {tuple(a[i : i + min(least, len(a))]) for i in range(len(a) - min(least, len(a)) + 1)} & {tuple(b[i : i + min(least, len(a))]) for i in range(len(b))}:
                continue
            found = brute.tiles(a, b, least)
            n = sum(x[2] for x in found)
            if found and n >= threshold * len(a):
                out.add((doc, item, len(found), n))
    return out


def test_tiles():
    r = random.Random(2)
    for _ in range(150):
        a = [r.randrange(4) for _ in range(r.randrange(1, 16))]
        b = [r.randrange(4) for _ in range(r.randrange(30))]
        got = tile(np.array(a, np.uint64), np.array(b, np.uint64), 2)
        assert got == brute.tiles(a, b, 2)


def data(seed=1):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["É", "the", "of"]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([0, 2, 4, 20, 40])))) for i in range(20)] + [(50, None)]
    docs = []
    for i in range(60):
        w = [r.choice(vocab) for _ in range(r.randrange(80))]
        part = (items[i % 20][1] or "").split()
        if i % 3 == 0:  # reordered halves, upper case and other marks
            half = len(part) // 2
            w = w + [x.upper() + "," for x in part[half:]] + ["between"] + part[:half]
        elif i % 3 == 1:
            w = w + part[: len(part) // 3]
        docs.append((i, "  ".join(w)))
    return docs + [(99, None), (98, "")], items


def test_both_ways_against_brute_force(spark):
    docs, items = data()
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = plain(docs, items, 5, 0.5)
    assert len(want) >= 5
    for sent in (2_000_000, 0):
        assert {(r.doc_id, r.item_id, r.n_tiles, r.covered) for r in leaks(d, b, max_sent=sent).collect()} == want
    left = {r.doc_id for r in drop_leaking(d, b).collect()}
    assert left == {x[0] for x in docs} - {x[0] for x in want}
    assert leaks(d.limit(0), b).count() == 0 and leaks(d, b.limit(0)).count() == 0


def test_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r.doc_id, r.item_id) for r in op8_decontamination(spark, sf).collect()}
    whole = {(d, i) for d, t in docs for i, p in items if t and p in t}
    assert whole and whole <= got
    assert all(set(words(dict(items)[i])) & set(words(dict(docs)[d])) for d, i in got)


def test_clashing_columns_and_long_texts(spark):
    r = random.Random(9)
    passage = " ".join(f"q{r.randrange(10**6)}" for _ in range(40))
    long_text = "same " * 60_000 + passage + " end" * 40_000
    docs = spark.createDataFrame([(1, long_text, 5, "x", "y", 2), (2, "same " * 50, 5, "x", "y", 2), (3, None, 1, "x", "y", 2)], "doc_id long, text string, item_id long, key string, __bad string, covered long")
    items = spark.createDataFrame([(10, passage, 1, "z"), (11, "same " * 40, 1, "z")], "item_id long, text string, doc_id long, h string")
    for sent in (2_000_000, 0):
        got = {(x.doc_id, x.item_id, x.n_tiles, x.covered) for x in leaks(docs, items, max_sent=sent).collect()}
        assert got == {(1, 10, 1, 40), (1, 11, 1, 40), (2, 11, 1, 40)}
    kept = drop_leaking(docs, items.where("item_id = 11"))
    assert kept.columns == docs.columns and [x.doc_id for x in kept.collect()] == [3]


def test_tokens_of_two_letters_in_a_pattern(spark):
    n = 1 << 11
    one = "".join("b" if bin(i).count("1") % 2 else "a" for i in range(n))
    other = one.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, f"p q {one} r s"), (2, f"p q {other} r s")], "doc_id long, text string")
    items = spark.createDataFrame([(1, f"p q {other} r s")], "item_id long, text string")
    assert [(x.doc_id, x.covered) for x in leaks(docs, items).collect()] == [(2, 5)]
