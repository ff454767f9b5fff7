"""Briefs as PDF: what is written is read; other writers' files by hand."""

import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.graph import Graph
from weftgraph.sources import pdf, sinks


@settings(deadline=None, max_examples=80)
@given(st.lists(st.text(st.characters(codec="utf-8", categories=["L", "N", "P", "S", "Zs"]), max_size=120), max_size=80))
def test_what_is_written_is_read(lines):
    lines = ["first", *lines, "last"]
    got = pdf.read(pdf.write(lines, "t"))
    want = [x for line in lines for x in pdf.wrapped(line)]
    assert [x for x in got.split("\n") if x.strip()] == [x for x in want if x.strip()]


def by_hand(content, font=b"<< /Type /Font /Subtype /Type1 /Encoding /MacRomanEncoding >>", packed=False, filters=b"/FlateDecode"):
    """A file whose page tree is in an object stream, without a table of places."""
    inner = [(1, b"<</Type/Catalog/Pages 2 0 R>>"), (2, b"<</Type/Pages/Kids[3 0 R]/Count 1/Resources<</Font<</F 4 0 R>>>>>>"), (3, b"<</Type/Page/Parent 2 0 R/Contents[5 0 R]>>"), (4, font)]
    body = zlib.compress(content)
    out = b"%PDF-1.5\n5 0 obj<</Length 9 0 R/Filter" + filters + b">>stream\r\n" + body + b"\r\nendstream endobj 9 0 obj %d endobj\n" % len(body)
    if packed:
        bodies = b" ".join(x for _, x in inner)
        at, heads = 0, b""
        for n, x in inner:
            heads += b"%d %d " % (n, at)
            at += len(x) + 1
        z = zlib.compress(heads + bodies)
        return out + b"7 0 obj<</Type/ObjStm/N %d/First %d/Length %d/Filter/FlateDecode>>stream\n%b\nendstream endobj" % (len(inner), len(heads), len(z), z)
    return out + b"".join(b"%d 0 obj %b endobj\n" % x for x in inner) + b"trailer<</Root 1 0 R>>"


@pytest.mark.parametrize("packed", [False, True])
def test_files_of_other_writers(packed):
    content = rb"q BT /F 12 Tf 1 0 0 1 50 700 Tm [(Hel) -20 (lo) -300 (w\157rld)] TJ 0 -14 Td (\(two\) \216) ' ET BI /W 1 ID )((x EI BT /F 9 Tf (th" + b"\\\n" + rb"ree) Tj ET Q"
    assert pdf.read(by_hand(content, packed=packed)) == "Hello world\n(two) \u00e9\nthree"


def test_codes_by_differences_and_ranges():
    font = b"<</Type/Font/Subtype/Type1/Encoding<</Differences[65/uni6F22/x]>>>>"
    assert pdf.read(by_hand(b"BT /F 1 Tf (ABC) Tj ET", font)) == "\u6f22xC"


def test_what_can_not_be_read():
    good = by_hand(b"BT /F 1 Tf (text) Tj ET")
    assert pdf.read(good) == "text"
    for bad in (b"", b"no pdf", good[:200], good.replace(b"trailer<<", b"trailer<</Encrypt 1 0 R"), by_hand(b"0 0 m"), by_hand(b"BT (x) Tj ET", filters=b"/DCTDecode"), b"%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 1 0 R/Kids[1 0 R]>>endobj"):
        assert pdf.read(bad) is None
    assert pdf.read(by_hand(b"BT (x) Tj ET" + b" " * (1 << 20)), most=1 << 16) is None
    r = random.Random(5)
    for _ in range(200):
        broken = bytearray(good)
        for _ in range(8):
            broken[r.randrange(len(broken))] = r.randrange(256)
        assert pdf.read(bytes(broken)) is None or isinstance(pdf.read(bytes(broken)), str)


def test_briefs(spark):
    g = Graph.literal(spark, [("A", "country", 0.5), ("B", "person"), ("C", None)], [("A", f"T{i:02}", "sees") for i in range(10)] + [("B", "A", None)])
    files = sinks.pdf_briefs(g, spark.createDataFrame([("A",), ("C",), ("missing",)], "id string"))
    got = {r.id: r.text for r in sinks.pdf_text(files).collect()}
    assert set(got) == {"A", "C"}
    lines = got["A"].split("\n")
    assert lines[:4] == ["# Knowledge graph brief", "## A", "Type: COUNTRY, confidence: 50%", "Outgoing:"] and lines[-2:] == ["Incoming:", "B \u2192 relates to \u2192 A"]
    assert [x for x in lines if "sees" in x] == [f"A \u2192 sees \u2192 T{i:02}" for i in range(8)]
