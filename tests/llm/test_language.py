from pyspark.sql import functions as F

from statewell.llm.langid import held_out, predict, prototypes
from statewell.llm.queries import op3_language_id


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = op3_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 40
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "12 !?", "de"), (5, "der mund", None), (6, "", None), (7, "the hand " * 50_000, None), (7, "日本", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    model = prototypes(df)
    got = sorted((r.doc_id, r.lang_pred) for r in predict(df.withColumn("__text", F.lit(1)), model).collect())
    assert got[:6] == [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "de"), (6, "und")]
    assert (7, "en") in got and len(got) == 8 and got[6][1] in ("de", "en") and got[7][1] in ("de", "en")
    assert predict(df.limit(0), model).count() == 0
    empty = prototypes(df.where("false"))
    assert empty[0] == [] and {r.lang_pred for r in predict(df, empty).collect()} == {"und"}


def test_remainder(spark):
    import zlib

    got = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)


def test_rows_are_those_of_single_trigrams(spark, sf):
    """All documents of the table, bound and bundled one trigram at a time."""
    import zlib
    from collections import Counter

    import numpy as np

    from statewell.llm.langid import DIM, SEED, SLOTS

    letters = np.random.default_rng(SEED).integers(0, 2, (SLOTS, DIM)) * 2 - 1

    def slot(c):
        return ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % (SLOTS - 27) if c.isalpha() else 0

    def bundle(text):
        symbols = [0]
        for s in [slot(c) for c in (text or "").lower()] + [0]:
            if s or symbols[-1]:
                symbols.append(s)
        out = np.zeros(DIM)
        for (a, b, c), n in Counter(zip(symbols, symbols[1:], symbols[2:])).items():
            if b:
                out += n * np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
        return out

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in docs}
    bundles = {r.doc_id: bundle(r.text) for r in docs}
    sums = {}
    for r in docs:
        if not held[r.doc_id] and r.lang is not None and r.text is not None:
            sums[r.lang] = sums.get(r.lang, 0) + bundles[r.doc_id]
    got = {r.doc_id: r for r in op3_language_id(spark, sf).collect()}
    assert len(got) == len(docs)
    for r in docs:
        mine, v = got[r.doc_id], bundles[r.doc_id]
        assert mine.held_out == held[r.doc_id]
        if not any(c.isalpha() for c in r.text or ""):
            assert (mine.lang_pred, mine.score) == ("und", 0.0)
            continue
        cosine = {k: s @ v / (np.linalg.norm(s) * np.linalg.norm(v)) for k, s in sums.items()}
        assert abs(mine.score - max(max(cosine.values()), 0)) < 1e-5
        assert cosine[mine.lang_pred] > max(cosine.values()) - 1e-5
