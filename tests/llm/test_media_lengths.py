import io
import struct
import zipfile

from statewell.llm.media import sniff

PDF = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"


def box(kind, data, size=None):
    return struct.pack(">I", 8 + len(data) if size is None else size) + kind + data


def zipped(members, comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.comment = comment
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def test_pdf_ends_at_its_last_section():
    linear = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n0\n%%EOF\n2 0 obj\nendobj\nxref\n0 1\nstartxref\n9\n%%EOF"
    saved = PDF + b"\n3 0 obj\nendobj\nxref\n0 1\nstartxref\n%d\n%%%%EOF" % (len(PDF) + len(b"\n3 0 obj\nendobj\n"))
    outer = b"%PDF-1.4\n1 0 obj\nstream\n" + PDF + b"\nendstream\nxref\n0 1\nstartxref\n"
    outer += b"%d\n%%%%EOF" % outer.index(b"xref\n0 1")
    for data in (linear, saved, outer):
        assert sniff(data) == [(0, len(data), "pdf")]
        assert sniff(b"text " + data + b" more") == [(5, len(data), "pdf")]
    assert sniff(PDF + b"\n" + saved) == [(0, len(PDF), "pdf"), (len(PDF) + 1, len(saved), "pdf")]


def test_mp4_boxes_of_all_sizes():
    ftyp = box(b"ftyp", b"isom\0\0\0\0")
    moov = box(b"moov", b"abcd")
    long = struct.pack(">I4sQ", 1, b"mdat", 20) + b"wxyz"
    for data in (ftyp + moov, ftyp + long + moov, ftyp + moov + box(b"mdat", b"to the end", 0)):
        assert sniff(data) == [(0, len(data), "mp4")]
    assert sniff(ftyp) == [] and sniff(ftyp + box(b"free", b"")) == []
    assert sniff(ftyp + moov + long[:-1]) == []
    assert sniff(ftyp + moov + b" and more text") == [(0, len(ftyp + moov), "mp4")]


def test_zip_with_a_stored_archive():
    data = zipped([("inner.zip", zipped([("a", "text")])), ("b", "more")], b"a comment")
    assert sniff(data) == [(0, len(data), "zip")]
    assert sniff(b"x" + data + zipped([]))[0] == (1, len(data), "zip")
    assert [x for x in sniff(data[:-3]) if x[0] == 0] == []
