"""Media columns: types by signature, and media embedded in other bytes.

One pass of an Aho-Corasick automaton finds every place of every known signature.
For each, the format's validator walks the structure there (chunks, blocks, markers)
and gives its length, or rejects it. The valid format at byte 0 is the detected type,
which corrects the declared one; valid ones further in are carved.

Defined results: null or empty bytes have detected type null and nothing carved; a
signature whose structure is broken is no detection; of overlapping embedded media the
outer is carved; other columns pass :func:`sniff_media` unchanged; empty tables give no
rows.
"""

from __future__ import annotations

import re
import struct
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, unused

# Public magic bytes, by format, and the place of the signature in it.
SIGNATURES = [
    (b"\x89PNG\r\n\x1a\n", "png", 0),
    (b"\xff\xd8\xff", "jpeg", 0),
    (b"GIF87a", "gif", 0),
    (b"GIF89a", "gif", 0),
    (b"RIFF", "riff", 0),
    (b"BM", "bmp", 0),
    (b"%PDF-", "pdf", 0),
    (b"PK\x03\x04", "zip", 0),
    (b"fLaC", "flac", 0),
    (b"OggS", "ogg", 0),
    (b"ftyp", "mp4", 4),
]


def png(data: memoryview) -> int | None:
    """Length up to IEND, all chunks' checksums right."""
    at, kinds = 8, []
    while at + 12 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 12 + size > len(data):
            return None
        if zlib.crc32(data[at + 4 : at + 8 + size]) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
            return None
        kinds.append(bytes(data[at + 4 : at + 8]))
        at += 12 + size
        if kinds[-1] == b"IEND":
            return at if kinds[0] == b"IHDR" else None
    return None


def jpeg(data: memoryview) -> int | None:
    """Length up to the end-of-image marker; segments before a scan must hold together."""
    at, scan = 2, False
    while at + 2 <= len(data):
        if data[at] != 0xFF:
            return None
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
        elif mark == 0xD9:
            return at + 2 if scan else None
        elif mark == 0x01 or 0xD0 <= mark <= 0xD7:
            at += 2
        else:
            if at + 4 > len(data):
                return None
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            if size < 2:
                return None
            at += 2 + size
            if mark == 0xDA:
                scan = True
                raw = bytes(data[at:])
                i = 0
                while True:  # the next marker that is neither a stuffed byte nor a restart
                    i = raw.find(b"\xff", i)
                    if i < 0 or i + 1 >= len(raw):
                        return None
                    if raw[i + 1] == 0 or 0xD0 <= raw[i + 1] <= 0xD7:
                        i += 2
                    else:
                        break
                at += i
    return None


def gif(data: memoryview) -> int | None:
    """Length up to the trailer, over all blocks."""
    if len(data) < 13:
        return None
    at = 13 + (3 << (data[10] & 7) + 1 if data[10] & 0x80 else 0)

    def blocks(at: int) -> int | None:
        while at < len(data):
            if data[at] == 0:
                return at + 1
            at += 1 + data[at]
        return None

    while at < len(data):
        if data[at] == 0x3B:
            return at + 1
        if data[at] == 0x21:
            nxt = blocks(at + 2)
        elif data[at] == 0x2C and at + 10 <= len(data):
            nxt = blocks(at + 11 + (3 << (data[at + 9] & 7) + 1 if data[at + 9] & 0x80 else 0))
        else:
            return None
        if nxt is None:
            return None
        at = nxt
    return None


def riff_chunks(data: memoryview) -> dict[bytes, tuple[int, int]] | None:
    """Chunk name to (start, size), if all chunks fill the RIFF size."""
    if len(data) < 12:
        return None
    end = 8 + int.from_bytes(data[4:8], "little")
    if end > len(data):
        return None
    at, out = 12, {}
    while at + 8 <= end:
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if at + 8 + size > end:
            return None
        out[bytes(data[at : at + 4])] = (at + 8, size)
        at += 8 + size + size % 2
    return out if at == end else None


def riff(data: memoryview) -> tuple[str, int] | None:
    chunks = riff_chunks(data)
    if chunks is None:
        return None
    kind = bytes(data[8:12])
    size = 8 + int.from_bytes(data[4:8], "little")
    if kind == b"WAVE" and b"fmt " in chunks and b"data" in chunks:
        return "wav", size
    if kind == b"WEBP" and chunks.keys() & {b"VP8 ", b"VP8L", b"VP8X"}:
        return "webp", size
    return ("avi", size) if kind == b"AVI " and chunks else None


def bmp(data: memoryview) -> int | None:
    if len(data) < 54:
        return None
    size, _, offset, head, _, _, planes, depth = struct.unpack("<IIIIiiHH", data[2:30])
    return size if 54 <= size <= len(data) and 26 <= offset <= size and head >= 12 and planes == 1 and depth in (1, 4, 8, 16, 24, 32) else None


def pdf(data: memoryview) -> int | None:
    """Length up to the last %%EOF whose startxref names a cross-reference of this file.

    Those that name one of a later %PDF- header are of a file inside or behind this one.
    """
    raw = bytes(data)
    heads = [x.start() for x in re.finditer(rb"%PDF-", raw)][1:]
    ends = [(x.start(), int(x[1]), x.end()) for x in re.finditer(rb"startxref\s+(\d{1,19})\s+%%EOF", raw)]

    def named(at: int, stop: int) -> bool:
        return at < stop and re.match(rb"\s*(?:xref\b|\d+\s+\d+\s+obj\b)", raw[at : at + 64]) is not None

    for at, place, end in reversed(ends):
        if named(place, at) and not any(named(x + place, at) for x in heads if x < at):
            return end
    # no place is right: what ends before another file begins
    return max((end for at, place, end in ends if place < at and not any(x < at for x in heads)), default=None)


def zip_(data: memoryview) -> int | None:
    """Length up to the first end record that fits its directory; those of inner archives don't."""
    raw = bytes(data)
    end = raw.find(b"PK\x05\x06")
    while 0 <= end <= len(raw) - 22:
        size, start = struct.unpack("<II", raw[end + 12 : end + 20])
        stop = end
        if 0xFFFFFFFF in (size, start) and end >= 76 and raw[end - 20 : end - 16] == b"PK\x06\x07":
            stop = int.from_bytes(raw[end - 12 : end - 4], "little")
            if raw[stop : stop + 4] == b"PK\x06\x06":
                size, start = struct.unpack("<QQ", raw[stop + 40 : stop + 56])
        length = end + 22 + int.from_bytes(raw[end + 20 : end + 22], "little")
        if start + size == stop and length <= len(raw) and (size == 0 or raw[start : start + 4] == b"PK\x01\x02"):
            return length
        end = raw.find(b"PK\x05\x06", end + 1)
    return None


def flac(data: memoryview) -> int | None:
    """Metadata blocks must hold together; audio runs to the end of the bytes."""
    at, first = 4, True
    while at + 4 <= len(data):
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        if first and (kind & 0x7F or size != 34) or at + 4 + size > len(data):
            return None
        at, first = at + 4 + size, False
        if kind & 0x80:
            return len(data)
    return None


def ogg(data: memoryview) -> int | None:
    """Length of all pages from the first page on."""
    at = 0
    while at + 27 <= len(data) and data[at : at + 4] == b"OggS" and data[at + 4] == 0:
        n = data[at + 26]
        size = 27 + n + sum(data[at + 27 : at + 27 + n])
        if at + size > len(data):
            break
        at += size
    return at or None


def mp4(data: memoryview) -> int | None:
    """Length of all boxes from ftyp on, of 32-bit or 64-bit size or to the end; one must be moov or mdat."""
    at, kinds = 0, set()
    while at + 8 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), bytes(data[at + 4 : at + 8])
        least = 8
        if size == 1:
            size, least = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        elif size == 0 and kind in BOXES:
            size = len(data) - at
        if not kind.isalnum() or (at == 0) != (kind == b"ftyp"):
            break
        if size < least or at + size > len(data):
            if kind in BOXES:  # cut off
                return None
            break
        kinds.add(kind)
        at += size
    return at if kinds & {b"moov", b"mdat"} else None


#: Boxes that stand outermost; other names past the end are what follows the file.
BOXES = {b"moov", b"mdat", b"moof", b"mfra", b"free", b"skip", b"meta", b"sidx", b"uuid", b"wide", b"pdin"}
VALIDATORS = {"png": png, "jpeg": jpeg, "gif": gif, "bmp": bmp, "pdf": pdf, "zip": zip_, "flac": flac, "ogg": ogg, "mp4": mp4}
_AUTOMATON: list = []


def automaton() -> ahocorasick.Automaton:
    """Over bytes as latin-1 characters, built once a process."""
    if not _AUTOMATON:
        found = ahocorasick.Automaton()
        for magic, kind, place in SIGNATURES:
            found.add_word(magic.decode("latin-1"), (len(magic), kind, place))
        found.make_automaton()
        _AUTOMATON.append(found)
    return _AUTOMATON[0]


def sniff(data: bytes) -> list[tuple[int, int, str]]:
    """Start, length and type of the valid media in ``data``, outer ones only, in order."""
    view, out, free = memoryview(data), [], 0
    places = sorted({(end - size + 1 - place, kind) for end, (size, kind, place) in automaton().iter(data.decode("latin-1"))})
    for start, kind in places:
        if start < free and start < (out[-1][0] + out[-1][1] if out else 0) or start < 0:
            continue
        if kind == "riff":
            got = riff(view[start:])
            kind, size = got if got else (kind, None)
        else:
            size = VALIDATORS[kind](view[start:])
        if size:
            out.append((start, size, kind))
            free = start + size
    return out


def sniff_media(df: DataFrame, content: str = "content", declared: str | None = None) -> DataFrame:
    """Columns of ``df`` with detected_type, corrected_type, type_matches and carved.

    ``content`` is binary; ``declared`` names a column of types such as ``png``.
    ``carved`` lists media inside: start, length, type and bytes.
    """
    new = "detected_type string, media_length long, carved array<struct<start:long,length:long,type:string,content:binary>>"
    names = ["detected_type", "media_length", "carved", "corrected_type", "type_matches"]
    others = [x for x in df.columns if x not in names]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("content", pa.binary())]))

    @tidy
    def run(batches):
        for batch in batches:
            types, sizes, carved = [], [], []
            for data in batch.column(len(others)).to_pylist():
                found = sniff(data) if data else []
                whole = found[0] if found and found[0][0] == 0 else None
                types.append(whole[2] if whole else None)
                sizes.append(whole[1] if whole else None)
                inner = [x for x in found if x is not whole]
                carved.append([{"start": s, "length": n, "type": t, "content": data[s : s + n]} for s, n, t in inner])
            columns = [batch.column(x) for x in others] + [pa.array(types, pa.string()), pa.array(sizes, pa.int64()), pa.array(carved, kind)]
            yield pa.RecordBatch.from_arrays(columns, [*others, "detected_type", "media_length", "carved"])

    fields = ", ".join(f"`{x}` {df.schema[x].dataType.simpleString()}" for x in others)
    out = df.select(*others, F.col(content).cast("binary").alias(unused("__content", df.columns))).mapInArrow(run, f"{fields}, {new}")
    if declared is None:
        return out
    return out.withColumn("corrected_type", F.coalesce("detected_type", declared)).withColumn("type_matches", F.col("detected_type").eqNullSafe(F.col(declared)))


def wav(payload: bytes, rate: int = 8000) -> bytes:
    """``payload`` as the samples of a mono 8-bit PCM file."""
    pad = b"\x00" * (len(payload) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + pad


def wav_samples(data: bytes) -> bytes:
    chunks = riff_chunks(memoryview(data))
    start, size = chunks[b"data"]
    return data[start : start + size]


def store_text_as_media(docs: DataFrame, block: int = 192) -> DataFrame:
    """doc_id, n_bytes and media: each whole text as 8-bit samples, padded with blanks to ``block`` bytes."""

    @tidy
    def run(batches):
        for batch in batches:
            sizes, media = [], []
            for text in batch.column(1).to_pylist():
                raw = (text or "").encode()
                sizes.append(len(raw))
                media.append(wav(raw.ljust(max(1, -(-len(raw) // block)) * block)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_media(df: DataFrame) -> DataFrame:
    """``df`` (doc_id, n_bytes, media) with the sniffed type, the samples and a feature.

    The feature has the type, its length and what is embedded in it; null media have
    null samples and feature. Other columns are dropped.
    """

    @tidy
    def run(batches):
        for batch in batches:
            payloads, features = [], []
            for data in batch.column("media").to_pylist():
                if data is None:
                    payloads.append(None)
                    features.append(None)
                    continue
                found = sniff(data)
                ok = bool(found) and found[0][0] == 0 and found[0][2] == "wav" and found[0][1] == len(data)
                if not ok:
                    raise ValueError("stored media is damaged")
                samples = wav_samples(data)
                inner = [f"{t}@{s - 44}+{n}" for s, n, t in sniff(samples)]
                payloads.append(samples)
                features.append(";".join([f"wav:{len(data)}", *inner]))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("doc_id", "n_bytes", "media")), pa.array(payloads, pa.binary()), pa.array(features, pa.string())], ["doc_id", "n_bytes", "media", "payload", "feature"])

    return df.mapInArrow(run, "doc_id long, n_bytes long, media binary, payload binary, feature string")
