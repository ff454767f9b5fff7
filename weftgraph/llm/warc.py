"""WARC archives: a writer with revisit records, and a sequential reader.

An archive is a file of gzip members, one for each record. The writer makes the members in Arrow batches and lets Spark's
text writer put them out, so that archives land in any store Spark writes to: the last byte of a member is that of its
length's high byte, which is zero for less than 16 MiB, and is written as the "line separator" (a longer member is
followed by an empty one, which ends in a zero byte). A task begins a new archive after ARCHIVE_BYTES, so the reader, which
gets whole files from Spark's binaryFile source, holds that much and a record at most; it inflates them piece by piece,
frames records by Content-Length and verifies their digests.

Cases: a null payload is empty; a null url leaves out WARC-Target-URI; a null page_id is written as `null`. Of pages
with one payload of at least `least` bytes those with the largest page_id are responses, the others revisit it, and so do
repeated rows of other ids; rows that repeat the largest id are all responses. A long payload is one record, which must fit
a row. Spaces, control characters and bytes beyond ASCII in a url are percent-encoded, and percent signs with them; a header
of ours tells that, and reading takes it back. Extra columns are not read, whatever their names. An empty table writes
archives without records, which give an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.batches import bounded
from weftgraph.stage import new_path, stage

LEAST_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
RECORD_ID = "urn:page:"
PIECE = 1 << 16
#: Bytes of members after which a task begins a new archive.
ARCHIVE_BYTES = 64 << 20
_PLAIN = "!#$&'()*+,/:;=?@[]~"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: str | None, digest: str, date: str = DATE) -> bytes:
    """A record without compression; refers_to: the id of the page that a revisit record stands for."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{RECORD_ID}{'null' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None and quote(url, safe=_PLAIN + "%") == url:
        head.append(f"WARC-Target-URI: {url}")
    elif url is not None:
        head += [f"WARC-Target-URI: {quote(url, safe=_PLAIN)}", "X-Escaped-URI: yes"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{RECORD_ID}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: {digest}", f"WARC-Block-Digest: {_digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """As a gzip member that ends in a zero byte."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = z.compress(record) + z.flush()
    return out if out[-1] == 0 else out + member(b"")


@dataclass
class Record:
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""


def read_records(pieces: Iterator[bytes]) -> Iterator[Record]:
    """The records of an archive of gzip members, from its bytes in order. Raises ValueError where it is damaged."""
    z, out, waiting = zlib.decompressobj(31), bytearray(), b""
    for piece in pieces:
        waiting = piece
        while waiting:
            try:
                out += z.decompress(waiting, PIECE)
            except zlib.error as e:
                raise ValueError(f"damaged gzip member: {e}") from None
            waiting = z.unconsumed_tail
            if z.eof:
                waiting = z.unused_data
                if out:
                    yield _framed(bytes(out))
                z, out = zlib.decompressobj(31), bytearray()
    if out or not z.eof and z.unconsumed_tail:
        raise ValueError("the archive ends inside a record")


def _framed(data: bytes) -> Record:
    end = data.find(b"\r\n\r\n")
    lines = data[: max(end, 0)].decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("a member does not start with a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = int(headers["content-length"])
    block = data[end + 4 : end + 4 + length]
    if len(block) != length or data[end + 4 + length :] != b"\r\n\r\n":
        raise ValueError("a record's block and Content-Length differ")
    if headers.get("warc-block-digest", d := _digest(block)) != d:
        raise ValueError("a record's block and digest differ")
    return Record(headers, block)


def payload_of(record: Record) -> tuple[bytes, int]:
    """The payload (empty for a revisit) and the length that the full payload has; verifies the payload's digest."""
    head, _, payload = record.block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if record.headers["warc-type"] == "response" and (len(payload) != length or _digest(payload) != record.headers["warc-payload-digest"]):
        raise ValueError("a record's payload and digest or length differ")
    return payload, length


def plan_records(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html, refers_to: the page that a record revisits, as text, or null for a response."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    d = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).alias("size"))
    best = d.filter(F.col("size") >= least).groupBy("sha1", "size").agg(F.max("page_id").alias("best"), F.count(F.lit(1)).alias("n"))
    best = stage(best.filter("n > 1").select("sha1", "size", "best"), "warc-responses")
    revisits = F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best"))
    return d.join(best, ["sha1", "size"], "left").select("page_id", "url", "html", "sha1", F.when(revisits, F.col("best").cast("string")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, least: int = LEAST_BYTES, date: str = DATE, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes a record for each page (page_id, url, html) into archives under path."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = written = 0
        for batch in batches:
            rows = zip(*(batch.column(c) for c in ("page_id", "url", "html", "sha1", "refers_to")))
            out, number, held = [], [], 0

            def made() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(number, pa.int64())], ["member", "archive"])

            for page_id, url, html, sha1, refers_to in rows:
                digest = "sha1:" + base64.b32encode(bytes.fromhex(sha1.as_py())).decode()
                out.append(member(record_bytes(page_id.as_py(), url.as_py(), html.as_py().encode(), refers_to.as_py(), digest, date))[:-1])
                number.append(archive)
                held += len(out[-1])
                written += len(out[-1])
                if written >= archive_bytes:
                    archive, written = archive + 1, 0
                if held > 16 << 20 or len(out) >= 512:
                    yield made()
                    out, number, held = [], [], 0
            yield made()

    made = bounded(plan_records(pages, least)).mapInArrow(members, "member binary, archive bigint")
    made.select(F.col("member").cast("string"), "archive").write.option("lineSep", "\0").partitionBy("archive").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record: page_id, url, record_type, payload_bytes, payload_digest (hex), refers_to, payload."""
    schema = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"
    ids = lambda x: None if x is None or x == f"<{RECORD_ID}null>" else int(x[len(RECORD_ID) + 1 : -1])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data = memoryview(content.as_buffer())
                rows, held = [], 0
                for r in read_records(data[i : i + PIECE] for i in range(0, len(data), PIECE)):
                    h = r.headers
                    payload, length = payload_of(r)
                    url = h.get("warc-target-uri")
                    rows.append((ids(h["warc-record-id"]), unquote(url) if url and "x-escaped-uri" in h else url, h["warc-type"], length, base64.b32decode(h["warc-payload-digest"][5:]).hex(), ids(h.get("warc-refers-to")), payload))
                    held += len(payload)
                    if held > 8 << 20 or len(rows) >= 1000:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)

    return bounded(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path)).select("content").mapInArrow(records, schema)


_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])


def write_and_read(pages: DataFrame) -> DataFrame:
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)


SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html)) as n, sha1(html) as h from p),
b as (select h, n, max(page_id) as best from d where n >= 1000 group by h, n)
select page_id, cast(n as bigint) as payload_bytes, h as payload_digest,
  case when best is null or best = page_id then 'response' else 'revisit' end as record_type,
  case when best <> page_id then best end as refers_to
from d left join b using (h, n)
"""
