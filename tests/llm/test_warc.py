import gzip
import hashlib

import pytest

from tests.llm.helpers import LONG
from weftgraph.stage import new_path
from weftgraph.llm import warc

BIG, NEAR = "x" * 1000, "x" * 999
ROWS = [(1, "http://a/ü b\r\nX: y", BIG), (2, None, BIG), (3, "http://c", NEAR), (4, "http://d", NEAR), (5, "u", None), (6, "u", ""), (7, "u", LONG), (8, "u", LONG), (8, "u", LONG), (None, "u", BIG), (9, "u", "é" * 500), (10, "u", "é" * 500)]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, size string")


def want(rows):
    out = []
    for i, _, html in rows:
        p = (html or "").encode()
        best = max((j for j, _, h in rows if (h or "").encode() == p and j is not None), default=None)
        revisit = len(p) >= 1000 and i != best
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", best if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    path = new_path(spark, "warc-test")
    warc.write_archives(pages(spark, ROWS), path)
    got = warc.read_archives(spark, path).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want(ROWS)
    texts = {i: h or "" for i, _, h in ROWS}
    assert all(bytes(r.payload).decode() == texts[r.page_id] for r in got if r.record_type == "response")
    assert {r.url for r in got if r.page_id == 1} == {"http://a/ü b\r\nX: y"} and {r.url for r in got if r.page_id == 2} == {None}
    # the files are plain gzip members that other readers take
    for row in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path).collect():
        if row.content:
            assert gzip.decompress(bytes(row.content)).startswith(b"WARC/1.1\r\n")


def test_urls_and_archives_of_bounded_size(spark):
    """Urls come back as they were, escaped or not; a task begins a new archive when one is large enough."""
    urls = ["http://a/%20b", "http://a/ b%20", "http://a/é", "x", "", None, "http://a/" + "y" * 50_000]
    rows = [(i, u, hashlib.sha256(str(i).encode()).hexdigest() * 40) for i, u in enumerate(urls * 6)]
    path = new_path(spark, "warc-small")
    warc.write_archives(pages(spark, rows).coalesce(1), path, archive_bytes=4000)
    got = warc.read_archives(spark, path).collect()
    assert {r.page_id: r.url for r in got} == {i: u for i, u, _ in rows} and len(got) == len(rows)
    files = [r.length for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path).collect()]
    assert len(files) > 2 and max(files) < 5000


def test_empty_table(spark):
    assert warc.write_and_read(pages(spark, [])).collect() == []


def test_reader_frames_and_verifies():
    records = [warc.record_bytes(i, "http://a", bytes([i]) * i * 1000, None, warc._digest(bytes([i]) * i * 1000)) for i in range(5)]
    data = b"".join(map(warc.member, records))
    for step in (1, 7, 1 << 20):
        got = list(warc.read_records(data[i : i + step] for i in range(0, len(data), step)))
        assert [warc.payload_of(r)[0] for r in got] == [bytes([i]) * i * 1000 for i in range(5)]
    with pytest.raises(ValueError):
        list(warc.read_records(iter([data[:-9]])))
    with pytest.raises(ValueError):
        list(warc.read_records(iter([warc.member(records[3].replace(b"\x03\x03", b"\x03\x04", 1))])))
    with pytest.raises(ValueError):
        list(warc.read_records(iter([b"plain text"])))


def test_members_end_in_a_zero_byte():
    assert warc.member(b"a")[-1] == 0
    big = warc.member(bytes(17 << 20))
    assert big[-1] == 0 and len(gzip.decompress(big)) == 17 << 20
