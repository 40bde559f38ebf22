"""WARC archives as a chunked record table.

An archive is a table of rows (archive, record, chunk, chunks, data, running): the bytes
of a record in order, the first chunk with the WARC and HTTP headers, none with more than
``chunk_bytes`` of payload, each with the digest of the payload so far. All chunks of an archive, ordered by record and chunk, are the WARC
file. Oversized payloads are cut without a copy of the whole and read back chunk by
chunk with a running digest; no step holds a record's chunks together.

Records of equal payload of ``revisit_bytes`` or more: the one with the smallest id is
the response, the others are revisits with headers only.

Defined results: a null payload is empty; rows with a null id are written as
responses with an empty identifier; repeated rows are written each; columns but page_id,
url and the payload are dropped, also where they are named like columns of the chunk
table; empty tables give no records.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tidy

CHUNKS = "record long, chunk long, chunks long, data binary, running binary"
TABLE = f"archive int, {CHUNKS}"
#: Bytes of chunks that a writing task holds.
WRITE_BYTES = 4 << 20
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload_ok boolean"


def header(page_id, url: str | None, digest: str, size: int, refers_to) -> bytes:
    """The WARC header block of one record, with its closing blank line."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Target-URI: " + " ".join((url or "").split()),
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Payload-Length: {size}"]
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {size}\r\n\r\n"
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (size if refers_to is None else 0)}"]
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


def plan_revisits(pages: DataFrame, payload: str = "html", revisit_bytes: int = 100) -> DataFrame:
    """page_id, url, payload (binary), digest, refers_to.

    Equal payloads are found from ids, sizes and digests; the payloads only meet the ids
    that revisit, which are sent to them if Spark finds them small.
    """
    raw = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), raw.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    ids = rows.where((F.length("payload") >= revisit_bytes) & F.col("page_id").isNotNull()).select("page_id", "digest")
    least = ids.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to").drop("last")
    revisits = materialize(ids.join(least, "digest").where("refers_to < page_id").distinct(), "revisits")
    return rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")


def write_records(rows: DataFrame, chunk_bytes: int) -> DataFrame:
    """The chunk table of ``rows`` as :func:`plan_revisits` gives them.

    Chunks leave in batches of about ``WRITE_BYTES``. ``running`` is the digest of the
    payload up to the end of the chunk; a revisit has none.
    """
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def chunks_of(view, head: bytes, empty: bool):
        digest, n = hashlib.sha256(), max(1, -(-len(view) // chunk_bytes)) if not empty else 1
        for i in range(n):
            part = b"" if empty else view[i * chunk_bytes : (i + 1) * chunk_bytes]
            digest.update(part)
            data = b"".join([head if i == 0 else b"", part, b"\r\n\r\n" if i == n - 1 else b""])
            yield i, n, data, None if empty else digest.digest()

    @tidy
    def run(batches):
        record, held, size = 0, [], 0

        def emit():
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), types)], [x.split()[0] for x in CHUNKS.split(", ")])

        for batch in batches:
            for page, url, body, digest, refers in zip(*(batch.column(x) for x in ("page_id", "url", "payload", "digest", "refers_to"))):
                view = memoryview(body.as_buffer())
                head = header(page.as_py(), url.as_py(), digest.as_py(), len(view), refers.as_py())
                for chunk in chunks_of(view, head, refers.is_valid):
                    held.append((record, *chunk))
                    size += len(chunk[2])
                    if size >= WRITE_BYTES:
                        yield emit()
                        held, size = [], 0
                record += 1
        if held:
            yield emit()

    return rows.mapInArrow(run, CHUNKS).select(F.spark_partition_id().alias("archive"), "*")


class _Reader:
    """One record, fed chunk by chunk."""

    def __init__(self, first: bytes) -> None:
        end = first.index(b"\r\n\r\n")
        lines = first[:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        self.fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        self.left = int(self.fields["Content-Length"])
        self.digest, self.size, self.end = hashlib.sha256(), 0, b""
        rest = first[end + 4 :]
        http = rest.index(b"\r\n\r\n") + 4
        self.left -= http
        self.feed(rest[http:])

    def feed(self, data: bytes) -> None:
        part = data[: self.left]
        self.digest.update(part)
        self.size += len(part)
        self.left -= len(part)
        self.end += data[len(part) :]

    def row(self) -> tuple:
        if self.left or self.end != b"\r\n\r\n":
            raise ValueError("record is cut off")
        f = self.fields
        ident = lambda name: int(f[name][10:-1]) if f.get(name, "<urn:page:>") != "<urn:page:>" else None
        said = f["WARC-Payload-Digest"].removeprefix("sha256:")
        if f["WARC-Type"] == "revisit":
            return ident("WARC-Record-ID"), f["WARC-Target-URI"], int(f["X-Payload-Length"]), said, "revisit", ident("WARC-Refers-To"), True
        return ident("WARC-Record-ID"), f["WARC-Target-URI"], self.size, self.digest.hexdigest(), "response", None, self.digest.hexdigest() == said


def _read(batches):
    names = [x.split()[0] for x in READ.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
    reader, missing = None, 0
    for batch in batches:
        out = []
        for chunk, chunks, data, running in zip(*(batch.column(x) for x in ("chunk", "chunks", "data", "running"))):
            chunk, chunks, data, running = chunk.as_py(), chunks.as_py(), data.as_py(), running.as_py()
            if chunk == 0:
                reader, missing = _Reader(data), chunks - 1
            else:
                reader.feed(data)
                missing -= 1
            if running is not None and reader.digest.digest() != running:
                raise ValueError("a chunk's bytes and digest differ")
            if missing == 0:
                out.append(reader.row())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names)


def read_records(table: DataFrame) -> DataFrame:
    """The records of a chunk table. Only those of several chunks are shuffled, by record."""
    one = table.where("chunks = 1").select("chunk", "chunks", "data", "running").mapInArrow(_read, READ)
    many = table.where("chunks > 1").repartition("archive", "record").sortWithinPartitions("archive", "record", "chunk")
    return one.unionByName(many.select("chunk", "chunks", "data", "running").mapInArrow(_read, READ))


def archive_pages(pages: DataFrame, payload: str = "html", chunk_bytes: int = 1 << 16, revisit_bytes: int = 100) -> DataFrame:
    """Write ``pages`` as WARC records to a chunk table; return that table, read back from storage."""
    return materialize(write_records(plan_revisits(pages, payload, revisit_bytes), chunk_bytes), "archives")
