import io
import struct
import zipfile
import zlib

from statewell.llm.media import read_media, sniff, sniff_media, store_text_as_media, wav, wav_samples


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


PNG = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00" + b"\x3b"
JPEG = b"\xff\xd8\xff\xe0\x00\x10JFIF\0" + b"\0" * 9 + b"\xff\xda\x00\x02ab\xff\x00c\xff\xd0d\xff\xd9"
BMP = b"BM" + struct.pack("<IIIIiiHH", 58, 0, 54, 40, 1, 1, 1, 24) + b"\0" * 24 + b"\1\2\3\0"
PDF = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", "text")
    return out.getvalue()


def test_every_format_is_found_and_carved():
    for kind, data in (("png", PNG), ("gif", GIF), ("jpeg", JPEG), ("bmp", BMP), ("pdf", PDF), ("zip", zipped()), ("wav", wav(b"abcd"))):
        assert sniff(data) == [(0, len(data), kind)]
        assert sniff(b"some text " + data + b" more") == [(10, len(data), kind)]
        assert not [x for x in sniff(data[:-3]) if x[0] == 0]


def test_broken_structure_is_no_media():
    bad = PNG.replace(b"IDAT", b"IDAX")
    assert sniff(bad) == [] and sniff(b"BM is a word, GIF89a too; RIFF, %PDF- and PK") == []


def test_outer_media_wins():
    assert sniff(wav(PNG)) == [(0, len(wav(PNG)), "wav")]


def test_columns(spark):
    rows = [(1, PNG, "jpeg"), (2, None, "png"), (3, b"", None), (4, b"x" + GIF, "txt"), (4, b"x" + GIF, "txt")]
    df = spark.createDataFrame(rows, "detected_type long, content binary, kind string")
    got = [tuple(r) for r in sniff_media(df, "content", "kind").select("kind", "detected_type", "corrected_type", "type_matches", "carved.type", "carved.start").orderBy("content").collect()]
    assert ("jpeg", "png", "png", False, [], []) in got
    assert ("png", None, "png", False, [], []) in got
    assert got.count(("txt", None, "txt", False, ["gif"], [1])) == 2
    assert sniff_media(df.limit(0)).count() == 0


def test_text_round_trip(spark):
    texts = [None, "", "a", "é" * 96, "x" * 193, "y" * 300_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in read_media(store_text_as_media(df)).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        payload = bytes(got[i].payload)
        assert got[i].n_bytes == len(raw) and payload.rstrip(b" ") == raw and len(payload) % 192 == 0 and payload
        assert len(payload) - len(raw) < 192 + (not raw) and wav_samples(bytes(got[i].media)) == payload


def test_table(spark, sf):
    import hashlib

    from statewell.llm.queries import op2_media_columns

    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        raw = (r.text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        media = wav(payload)
        want[r.doc_id] = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), f"wav:{len(media)}")
    got = {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) for r in op2_media_columns(spark, sf).collect()}
    assert got == want
