"""Exact copies, filter interactions and source divergence: small tables with edges, against plain Python."""

import hashlib
import random
import re
from itertools import permutations

import pytest

from statewell.llm import exact_dedup, filter_audit, source_divergence
from statewell.llm.radix import Trie

DOCS = "doc_id long, text string, lang string, source string, kept string, own string, n long"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", "y", 7) for r in rows], DOCS).repartition(3)


def rows_of(seed=1):
    rng = random.Random(seed)
    base = ["", "a", "A", "ab", "abc", "É", "é", "abd" * 3000, "ABD" * 3000, "abd" * 3000 + "x", "x y z " * 50, "one #tag", "Ünï cödé wörd", "\t\n", "don't stop-me"]
    out = [(i, rng.choice(base), rng.choice(["en", "de", None]), rng.choice(["s", "t", "u", None])) for i in range(150)]
    out += [(200, None, "en", "s"), (201, None, None, None), (None, "ab", "en", "s"), (None, "nobody else", "en", "t"), (7, "another text of 7", "en", "s"), (7, "another text of 7", "en", "t"), (300, "alone", "xx", "only")]
    return out + [(400 + i, "THE SAME " * 30, "en", "hot") for i in range(100)]


def test_trie_walks_in_byte_order_and_spills_whole_subtrees():
    rng = random.Random(3)
    keys = {bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randrange(12))) for _ in range(400)} | {b"a" * 5000, b"a" * 5000 + b"b", b""}
    trie = Trie()
    for k in keys:
        trie.end(k).value = k
        trie.ends += 1
    assert [k for k, _ in trie.walk()] == sorted(keys)
    assert all(k == n.value for k, n in trie.walk())
    given = {k for k, _ in trie.spill(trie.size // 3)}
    assert given and given < keys
    assert {k for k, _ in trie.walk()} == keys - given and trie.ends == len(keys - given)
    # no string that was given away comes back
    assert all((trie.end(k) is None) == (k in given) for k in keys)


def test_one_string_is_never_spilled():
    trie = Trie()
    trie.end(b"x" * 1000).value = 1
    trie.ends = 1
    assert list(trie.spill(0)) == []


def copies_by_hand(rows, pick):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault((text or "").translate(UPPER), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [x for x in ids if x is not None]
        keep = pick(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(x, min(known, default=None), max(known, default=None), keep, len(ids), x == keep, sha) for x in ids]
    return sorted(map(repr, out))


@pytest.mark.parametrize("budget", [exact_dedup.BUDGET, 20_000, 600])
@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_copies_are_those_by_hand_at_every_budget(spark, budget, keep):
    rows = rows_of()
    got = exact_dedup.exact_copies(table(spark, rows), keep, budget)
    assert sorted(repr(tuple(r)) for r in got.collect()) == copies_by_hand(rows, max if keep == "largest" else min)


def test_kept_rows_keep_their_columns(spark):
    rows = rows_of()
    got = exact_dedup.drop_copies(table(spark, rows))
    assert got.columns == [x.split()[0] for x in DOCS.split(", ")]
    texts = [(r.text or "").translate(UPPER) for r in got.collect()]
    assert sorted(texts) == sorted({(t or "").translate(UPPER) for _, t, *_ in rows})


def audit_by_hand(rows, labels):
    facts, first = {}, {}
    for doc_id, text, _, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    for doc_id, text, _, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": doc_id is not None and doc_id > first[t]}
        mine = [x for x in labels if doc_id is not None and x[0] == doc_id]
        facts.setdefault(source or "", []).append((fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = {}
    for part, docs in facts.items():
        share = dict.fromkeys("ABCDE", 0)
        mine = []
        for order in permutations("ABCDE"):
            left = docs
            for step, x in enumerate(order, 1):
                gone = [d for d in left if d[0][x]]
                left = [d for d in left if not d[0][x]]
                share[x] += len(gone)
                redundant = sum(d[0][x] for d in docs) - len(gone)
                unique = sum(d[0][x] and sum(d[0].values()) == 1 for d in docs)
                mine.append((part, "".join(order), step, len(left), len(gone), redundant, unique, sum(d[1] for d in gone), sum(d[2] for d in gone)))
        out |= {x[:3]: (*x[3:], share[x[1][x[2] - 1]]) for x in mine}
    return out


def test_audit_counts_are_those_by_hand(spark):
    long_text = " ".join(f"w{i}" for i in range(300))
    rows = [*rows_of(), (500, long_text, "en", "s"), (501, long_text, "en", "t"), (502, long_text + " Q$", "en", "s"), (500, long_text, "en", "t"), (None, long_text, "en", "s"), (503, "A " * 400, "en", "u")]
    labels = [(500, 1, 0), (500, 0, 1), (501, None, 1), (None, 1, 1), (503, 1, None), (7, 0, 1), (9999, 1, 1)]
    frame = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, text string")
    got = filter_audit.audit(table(spark, rows), frame)
    want = audit_by_hand(rows, labels)
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r.part, r.filter_order, r.step): tuple(r[x] for x in names) for r in got.collect()} == want
    every = filter_audit.audit(table(spark, rows), frame, overall=True).where("part is null").collect()
    whole = audit_by_hand([(*r[:3], "all") for r in rows], labels)
    assert {("all", r.filter_order, r.step): tuple(r[x] for x in names) for r in every} == whole


def divergence_by_hand(rows, least, top):
    groups, held, counts = set(), {}, {}
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
        for x in set(terms):
            held[lang, x] = held.get((lang, x), 0) + 1
        for x in terms:
            counts[lang, source, x] = counts.get((lang, source, x), 0) + 1
    out = set()
    for lang in {x for x, _ in groups}:
        kept = sorted((t for (x, t), n in held.items() if x == lang and n >= least), key=str.encode)
        sources = [s for x, s in groups if x == lang]
        n = {s: {t: counts.get((lang, s, t), 0) for t in kept} for s in sources}
        whole = {t: sum(n[s][t] for s in sources) for t in kept}
        shares = {k: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for k, c in [*n.items(), (None, whole)]}
        value = lambda p, q: (p - q) * (p - q) // q
        for s in sources:
            p, q = shares[s], shares[None]
            pairs = sorted(((o, sum(value(p[t], shares[o][t]) for t in kept)) for o in sources if o != s), key=lambda x: (-x[1], x[0].encode()))
            best = sorted(((t, value(p[t], q[t])) for t in kept if n[s][t] and p[t] > q[t]), key=lambda x: (-x[1], x[0].encode()))[:top]
            out |= {(lang, s, part, item, v, i) for part, found in (("pair", pairs), ("term", best)) for i, (item, v) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("counters", [source_divergence.BUDGET_COUNTERS, 5])
def test_divergence_is_that_by_hand(spark, counters, monkeypatch):
    monkeypatch.setattr(source_divergence, "CELLS", 8)  # sources dealt in blocks, terms in short steps
    monkeypatch.setattr(source_divergence, "STEP", 200 if counters == 5 else source_divergence.STEP)  # long texts in pieces
    monkeypatch.setattr(source_divergence, "STEP_COUNTERS", 20 if counters == 5 else source_divergence.STEP_COUNTERS)
    rng = random.Random(5)
    words = ["Wort", "wort", "élan", "Élan", "naïve", "日本", "a", "b", "cc", "ccc", "x-y", "q1r"]
    rows = rows_of() + [(600 + i, " ".join(rng.choices(words, k=30)), rng.choice(["en", "de"]), rng.choice("stuvw")) for i in range(60)]
    got = source_divergence.divergence(table(spark, rows), 3, 4, counters, 10)
    assert {tuple(r) for r in got.collect()} == divergence_by_hand(rows, 3, 4)


def test_shares_are_exact():
    import numpy as np

    counts = [0, 1, 10**9, 10**12, 2**58 - 3]
    total = 2**59 - 1
    assert source_divergence.shares(np.array(counts), total).tolist() == [1 + 10**9 * (c + 1) // total for c in counts]


def test_empty_tables_give_no_rows(spark):
    docs = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert exact_dedup.exact_copies(docs).isEmpty()
    assert filter_audit.audit(docs, labels).isEmpty()
    assert source_divergence.divergence(docs).isEmpty()
    assert filter_audit.audit(table(spark, rows_of()), labels).where("good_lost + toxic_lost > 0").isEmpty()
