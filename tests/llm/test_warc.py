import hashlib

from statewell.llm.queries import op6_warc
from statewell.llm.warc import archive_pages, read_records


def want(pages):
    first, out = {}, {}
    for i, html in sorted(pages):
        body = (html or "").encode()
        least = first.setdefault(body, i) if len(body) >= 100 else i
        out[i] = (len(body), hashlib.sha256(body).hexdigest(), "response" if least == i else "revisit", None if least == i else least)
    return out


def got(df):
    return {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()}


def test_chunks_of_any_size(spark):
    html = ["a" * 99, "a" * 100, "é" * 500, "\r\n\r\nWARC/1.1\r\n" * 40, None, "", "x" * 100_000]
    pages = [(i, html[i % len(html)]) for i in range(30)]
    df = spark.createDataFrame([(i, "http://a b/\n", h) for i, h in pages], "page_id long, url string, html string")
    for size in (7, 64, 1 << 16):
        table = archive_pages(df, chunk_bytes=size)
        assert got(read_records(table)) == want(pages)
        assert read_records(table).where("not payload_ok").count() == 0
    # the chunks in order are the archive
    rows = archive_pages(df, chunk_bytes=10).where("archive = 0").orderBy("record", "chunk").collect()
    raw = b"".join(bytes(r.data) for r in rows)
    assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n") and raw.count(b"WARC-Record-ID") == len({r.record for r in rows})


def test_table(spark, sf):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()]
    assert got(op6_warc(spark, sf)) == want(pages)


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, None, "z" * 200), (3, None, "z" * 200), (3, None, "z" * 200)], "page_id long, url string, html string")
    rows = sorted((r.page_id or -1, r.record_type) for r in read_records(archive_pages(df)).collect())
    assert rows == [(-1, "response"), (3, "response"), (3, "response")]
    assert read_records(archive_pages(df.limit(0))).count() == 0


def test_a_payload_of_many_chunks(spark):
    body = "x" * 3_000_000 + "é"
    df = spark.createDataFrame([(1, "u", body), (2, "u", body), (2, "u", "other" * 30), (3, None, "")], "page_id long, url string, html string")
    table = archive_pages(df, chunk_bytes=1 << 16)
    rows = table.where("chunks > 1").orderBy("chunk").collect()
    assert len(rows) == 46 and max(len(r.data) for r in rows) < (1 << 16) + 1000
    raw = body.encode()
    assert [bytes(r.running) for r in rows] == [hashlib.sha256(raw[: (i + 1) << 16]).digest() for i in range(46)]
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to or 0) for r in read_records(table).collect())
    assert got == [(1, 3_000_002, "response", 0), (2, 150, "response", 0), (2, 3_000_002, "revisit", 1), (3, 0, "response", 0)]


def test_clashing_columns(spark):
    pages = [(1, "a" * 200), (2, "a" * 200), (3, None)]
    rows = [(i, "http://a/", h, "x", 7, 8, "y", True) for i, h in pages]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string, record long, chunk long, digest string, refers_to boolean")
    assert got(read_records(archive_pages(df))) == want(pages)
