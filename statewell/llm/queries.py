"""The registered query of each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, exact_dedup, filter_audit, langid, licenses, media, simhash, source_divergence, token_counts, warc
from .substring_dedup import dedup_substrings
from .suffix_dedup import dedup_bytes

#: The rank files of public tokenizers; a parameter of the operators.
MULTI_RANKS, RANKS = "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_substrings(docs, window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.read_media(media.store_text_as_media(_table(spark, sf_dir, "documents")))
    return out.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", langid.held_out(F.col("doc_id")).alias("held_out"))
    model = langid.prototypes(docs.where("not held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_bytes(docs, length=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.archive_pages(_table(spark, sf_dir, "pages"))
    return warc.read_records(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, vocabulary(RANKS)).select("doc_id", "n_words", "n_tokens")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs, licenses.train(docs))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = vocabulary(MULTI_RANKS), split_pattern()
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode(docs, path, pattern, decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = exact_dedup.exact_copies(_table(spark, sf_dir, "documents"), keep="largest")
    return copies.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_media_columns,
        op3_language_id,
        op4_simhash_dedup,
        op5_suffix_dedup,
        op6_warc,
        op7_token_counts,
        op8_decontamination,
        op9_license_scan,
        op10_byte_bpe,
        op11_exact_dedup,
        op12_filter_audit,
        op13_source_divergence,
    )
}

ORACLES: dict[str, str] = {
    "op6_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        d AS (SELECT page_id, octet_length(body) AS n, sha256(body) AS digest FROM p),
        m AS (SELECT digest, min(page_id) AS least FROM d WHERE n >= 100 GROUP BY digest)
        SELECT d.page_id, d.n AS payload_bytes, d.digest AS payload_digest,
               CASE WHEN m.least < d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN m.least < d.page_id THEN m.least END AS refers_to
        FROM d LEFT JOIN m USING (digest)
    """,
    "op1_substring_dedup": r"""
        WITH t AS (
            SELECT doc_id, CASE WHEN text IS NULL THEN []::VARCHAR[] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w FROM documents
        ), s AS (
            SELECT doc_id, unnest(range(0, len(w) - 19)) AS s, unnest(list_transform(range(0, len(w) - 19), lambda i: md5_number(array_to_string(w[i + 1 : i + 20], ' ')))) AS h FROM t WHERE len(w) >= 20
        ), x AS (
            SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS k FROM s
        ), c AS (
            SELECT doc_id, s, coalesce(s > max(s + 20) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM x WHERE k > 1
        ), g AS (
            SELECT doc_id, s, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM c
        ), i AS (
            SELECT doc_id, run, min(s) AS a, max(s) + 20 AS b FROM g GROUP BY 1, 2
        ), j AS (
            SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM i
        ), k AS (
            SELECT doc_id, sum(b - a)::BIGINT AS n_removed, max(b) AS b, flatten(list(w[last + 1 : a] ORDER BY a)) AS kept FROM j JOIN t USING (doc_id) GROUP BY 1
        )
        SELECT t.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed,
               sha256(coalesce(array_to_string(CASE WHEN b IS NULL THEN w ELSE list_concat(kept, w[b + 1 :]) END, ' '), '')) AS kept_sha256
        FROM t LEFT JOIN k USING (doc_id)
    """,
    "op5_suffix_dedup": r"""
        WITH t AS (
            SELECT doc_id, encode(coalesce(text, '')) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
        ), s AS (
            SELECT doc_id, unnest(range(0, n - 99)) AS s, unnest(list_transform(range(0, n - 99), lambda i: md5_number(h[i + 1 : i + 100]))) AS w FROM t WHERE n >= 100
        ), x AS (
            SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS k FROM s
        ), c AS (
            SELECT doc_id, s, coalesce(s > max(s + 100) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM x WHERE k > 1
        ), g AS (
            SELECT doc_id, s, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM c
        ), i AS (
            SELECT doc_id, run, min(s) AS a, max(s) + 100 AS b FROM g GROUP BY 1, 2
        ), j AS (
            SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM i
        ), k AS (
            SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS b, string_agg(hex(h[last + 1 : a]), '' ORDER BY a) AS kept FROM j JOIN t USING (doc_id) GROUP BY 1
        )
        SELECT t.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(CASE WHEN b IS NULL THEN h ELSE unhex(kept || hex(h[b + 1 :])) END) AS kept_sha256
        FROM t LEFT JOIN k USING (doc_id)
    """,
    "op11_exact_dedup": """
        WITH n AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
        ), g AS (
            SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, sha256(t) AS text_sha256 FROM n
        )
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
    """,
    "op12_filter_audit": r"""
        WITH d AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), f AS (
            SELECT part,
                   CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
                   + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
                   + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
                   + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
                   + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS fails,
                   doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good,
                   doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic
            FROM d
        ), g AS (
            SELECT part, fails, count(*) AS n, coalesce(sum(good::INT), 0) AS good, coalesce(sum(toxic::INT), 0) AS toxic FROM f GROUP BY 1, 2
        ), l AS (
            SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit
        ), o AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
            FROM l a, l b, l c, l d, l e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
        ), s AS (
            SELECT filter_order, i::INT AS step, bits[i] AS bit, coalesce(list_sum(bits[1 : i - 1]), 0)::INT AS past FROM o, range(1, 6) t(i)
        ), r AS (
            SELECT part, filter_order, step, bit,
                   sum(CASE WHEN fails & (past | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
                   sum(CASE WHEN fails & past = 0 AND fails & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
                   sum(CASE WHEN fails & past > 0 AND fails & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
                   sum(CASE WHEN fails = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
                   sum(CASE WHEN fails & past = 0 AND fails & bit > 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
                   sum(CASE WHEN fails & past = 0 AND fails & bit > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
            FROM g, s GROUP BY 1, 2, 3, 4
        )
        SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
    """,
    "op13_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
        ), o AS (
            SELECT r, lang, source, unnest(w) AS term FROM d
        ), k AS (
            SELECT lang, term FROM o GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3
        ), v AS (
            SELECT lang, count(*) AS v FROM k GROUP BY 1
        ), g AS (
            SELECT DISTINCT lang, source FROM d
        ), c AS (
            SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3
        ), t AS (
            SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2
        ), p AS (
            SELECT t.lang, t.source, k.term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (total + v) AS p
            FROM t JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
        ), q AS (
            SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n) + 1) // (sum(sum(n)) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q FROM c GROUP BY 1, 2
        ), pairs AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
        ), x AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
        ), y AS (
            SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM x
        )
        SELECT * FROM y WHERE part = 'pair' OR rank <= 200
    """,
}
