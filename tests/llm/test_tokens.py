import hashlib
import random

import public_tokenizers
import tiktoken

from statewell.llm import bpe, token_counts
from statewell.llm.queries import MULTI_RANKS, op7_token_counts, op10_byte_bpe, split_pattern, vocabulary

from . import brute


def tiktoken_encoding():
    ranks = bpe.Codec(vocabulary(MULTI_RANKS), split_pattern()).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_on_any_text():
    own, want = bpe.Codec(vocabulary(MULTI_RANKS), split_pattern()), tiktoken_encoding()
    r = random.Random(8)
    pools = ["abcdefgh", "it's we'll ", " \t\n\r\x1c\x1f\x85\xa0 　​", "日本語🙂é́ßñ", "0123４５½", "!?.,;:=-_", "\x00\x7f\U0010ffff"]
    texts = ["", "a", " ", "=" * 500, "ab" * 300, " " * 200 + "x", "the theatre of the others", "̀a"]
    for _ in range(600):
        pool = "".join(r.sample(pools, r.randrange(1, 5)))
        texts.append("".join(r.choice(pool) for _ in range(r.randrange(120))))
    for _ in range(2):  # the second time from memory
        ids, bound = own.encode(texts)
        for text, a, b in zip(texts, bound, bound[1:]):
            assert ids[a:b].tolist() == want.encode_ordinary(text), text
        assert own.decode(ids, bound) == [t.encode() for t in texts]


def test_bpe_forgets(monkeypatch):
    own, want = bpe.Codec(vocabulary(MULTI_RANKS), split_pattern()), tiktoken_encoding()
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    for i in range(10):
        texts = [f"word{i} word{i + 1} the of and {j * i}" for j in range(9)]
        ids, bound = own.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(bound, bound[1:])] == [want.encode_ordinary(t) for t in texts]
        assert len(own.known) <= 60


def test_bpe_table(spark, sf):
    want, out = tiktoken_encoding(), {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = want.encode_ordinary(r.text or "")
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        out[r.doc_id] = (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op10_byte_bpe(spark, sf).collect()} == out


def test_bpe_odd_rows(spark):
    path, pattern = vocabulary(MULTI_RANKS), split_pattern()
    df = spark.createDataFrame([(None, None, "q"), (1, "", "q"), (2, "x", "q"), (2, "x", "q")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id or -1, r.n_tokens, bytes(r.decoded)) for r in bpe.decode(bpe.encode(df, path, pattern), path, pattern).collect())
    assert got == [(-1, 0, b""), (1, 0, b""), (2, 1, b"x"), (2, 1, b"x")]
    assert bpe.encode(df.limit(0), path, pattern).count() == 0


def test_counts_are_greedy():
    r = random.Random(4)
    for _ in range(60):
        vocab = {bytes(r.choice(b"abc") for _ in range(r.randrange(1, 6))) for _ in range(r.randrange(1, 15))}
        if r.random() < 0.7:
            vocab |= {b"a", b"b", b"c"}
        own = token_counts.Automaton(sorted(vocab))
        for _ in range(60):
            word = bytes(r.choice(b"abc") for _ in range(r.randrange(1, 14)))
            assert own.count(word) == (brute.greedy_tokens(word, vocab) or 1), (vocab, word)


def test_counts_table(spark, sf):
    vocab = set(token_counts.read_vocabulary(vocabulary("byte_bpe_50k.tiktoken")))
    out = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words = (r.text or "").encode().split()
        out[r.doc_id] = (len(words), sum(brute.greedy_tokens(b" " + w, vocab) for w in words))
    assert {r.doc_id: (r.n_words, r.n_tokens) for r in op7_token_counts(spark, sf).collect()} == out


def test_counts_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (None, "", 5), (2, " a  b ", 5)], "doc_id long, text string, n_words int")
    got = sorted((r.doc_id or -1, r.n_words, r.n_tokens) for r in token_counts.count_tokens(df, vocabulary("byte_bpe_50k.tiktoken")).collect())
    assert got == [(-1, 0, 0), (1, 0, 0), (2, 2, 2)]
    assert token_counts.count_tokens(df.limit(0), vocabulary("byte_bpe_50k.tiktoken")).count() == 0


def test_bpe_of_a_long_text_of_distinct_words(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    own, want = bpe.Codec(vocabulary(MULTI_RANKS), split_pattern()), tiktoken_encoding()
    r = random.Random(4)
    text = " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(600_000))
    ids, bound = own.encode(["x", text, ""])
    assert ids[bound[1] : bound[2]].tolist() == want.encode_ordinary(text)
    assert own.decode(ids, bound) == [b"x", text.encode(), b""]
    assert not list(tmp_path.iterdir())  # nothing is spilled beside the session
