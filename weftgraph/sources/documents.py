"""Document sources: text, Markdown, DOCX and PDF files, HTML pages, feeds, and registries of what was read."""

from __future__ import annotations

import io
import ipaddress
import re
import unicodedata
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from weftgraph.functions.text import html_text
from weftgraph.sources import pdf

MAX_FILE_BYTES = 10 << 20
MAX_MEMBER_BYTES = 64 << 20
MAX_TEXT = 50_000
MAX_REQUEST = 500_000
SHORT_ARTICLE = 200
PROCESSED_KEPT = 5000
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _member(z: zipfile.ZipFile, name: str, most: int = MAX_MEMBER_BYTES) -> bytes:
    """A member of an archive, if it isn't larger than `most` once inflated; what it says of its size doesn't count."""
    with z.open(name) as f:
        data = f.read(most + 1)
    if len(data) > most:
        raise ValueError("too large")
    return data


def docx_text(content: bytes) -> str | None:
    """Paragraphs, then table cells, of a DOCX file; None where it is none, is encrypted, broken, or inflates without a bound."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ElementTree.fromstring(_member(z, "word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, RuntimeError, NotImplementedError, EOFError, OSError, zlib.error):
        return None
    if body is None:
        return None
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t")).strip()
    parts = [text(p) for p in body.findall(f"{_W}p")] + [text(c) for c in body.iter(f"{_W}tc")]
    return "\n".join(p for p in parts if p)


def plain_text(content: bytes) -> str:
    return content.decode("utf-8", "ignore")


#: What reads a file of each kind: bytes to a text, or None where they have none.
READERS: dict[str, Callable[[bytes], str | None]] = {"txt": plain_text, "md": plain_text, "docx": docx_text, "pdf": pdf.read}


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, text, error of files of the known kinds; larger ones and others have an error. Bytes that are no UTF-8 are left out.

    Only files of a known kind and size reach Python, each kind its own reader; a reader's failure is its file's error.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    raw = raw.select("path", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("kind"), "length", "content")
    known, fits = F.col("kind").isin(*READERS), F.col("length") <= MAX_FILE_BYTES

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            out = []
            for path, kind, content in zip(x["path"], x["kind"], x["content"]):
                try:
                    text = READERS[kind](bytes(content))
                    out.append((path, kind, text, None if text is not None else "unreadable"))
                except Exception as e:  # one file's failure is its own
                    out.append((path, kind, None, f"unreadable: {type(e).__name__}"))
            yield pd.DataFrame(out, columns=["path", "kind", "text", "error"])

    read = raw.filter(known & fits).select("path", "kind", "content").mapInPandas(run, "path string, kind string, text string, error string")
    why = F.when(~known, "unknown kind").otherwise("too large")
    return read.unionByName(raw.filter(~known | ~fits).select("path", "kind", F.lit(None).cast("string").alias("text"), why.alias("error")))


def pages_text(pages: DataFrame) -> DataFrame:
    """page_id, url, the whole text, error."""
    rows = pages.select("page_id", "url", html_text(F.col("html")).alias("text"))
    return rows.select("page_id", "url", "text", F.when(F.col("text").isNull(), "no readable text").alias("error"))


_NUMBERS = r"^(0[xX][0-9A-Fa-f]*|[0-9]+)([.](0[xX][0-9A-Fa-f]*|[0-9]+)){0,3}[.]?$"


def address_of(host: str) -> ipaddress.IPv4Address | ipaddress.IPv6Address | None:
    """The address that a host is in any spelling that resolvers take: one to four numbers, decimal, octal or hexadecimal."""
    try:
        return ipaddress.ip_address(host.split("%")[0])
    except ValueError:
        pass
    if not re.match(_NUMBERS, host):
        return None
    try:
        parts = [int(x, 16) if x[:2].lower() == "0x" else int(x, 8 if x[:1] == "0" else 10) for x in (y if y.lower() != "0x" else "0" for y in host.rstrip(".").split("."))]
    except ValueError:
        return None
    *first, last = parts
    if any(x > 255 for x in first) or last >= 256 ** (4 - len(first)):
        return None
    return ipaddress.IPv4Address(sum(x << 8 * (3 - i) for i, x in enumerate(first)) + last)


def blocked_address(ip: ipaddress.IPv4Address | ipaddress.IPv6Address) -> bool:
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified


def blocked_host(host: str) -> bool:
    """Whether a host is a private or reserved address, or a name of the own network; digits of any script count."""
    host = unicodedata.normalize("NFKC", host).strip("[]").lower()
    if re.search(r"(^|\.)(localhost|local|internal|metadata)\.?$", host):
        return True
    ip = address_of(host)
    return blocked_address(ip) if ip else bool(re.match(r"^[0-9.]*$", host))


@F.pandas_udf(BooleanType())
def _blocked_udf(host: pd.Series) -> pd.Series:
    return host.map(lambda h: None if h is None else blocked_host(h))


def url_allowed(url: Column) -> Column:
    """Whether a url is http or https and its host neither private nor reserved.

    Names of plain letters are judged here; only their hosts' places go to Python as nulls, which cost next to nothing.
    """
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#\\]*@)?(\[[^\]]*\]|[^/?#:\\]*)", 1)
    web = F.lower(url).rlike("^https?://") & (host != "")
    named = F.lower(host).rlike(r"(^|\.)(localhost|local|internal|metadata)\.?$")
    odd = host.rlike(_NUMBERS + r"|^[0-9.]*$|^\[|[^\x21-\x7e]|%")
    return F.coalesce(web & ~named & F.coalesce(~_blocked_udf(F.when(odd, host)), F.lit(True)), F.lit(False))


def long_enough(text: Column, least: int = SHORT_ARTICLE) -> Column:
    return F.length(F.trim(text)) >= least


def request_ok(text: Column, most: int = MAX_REQUEST) -> Column:
    return (F.length(F.trim(text)) > 0) & (F.length(text) <= most)


# The feeds that are read where none are given.
DEFAULT_FEEDS = (
    ("https://feeds.bbci.co.uk/news/world/rss.xml", "BBC World"),
    ("https://www.aljazeera.com/xml/rss/all.xml", "Al Jazeera"),
    ("https://www.reuters.com/world/rss", "Reuters World"),
    ("https://feeds.npr.org/1004/rss.xml", "NPR World"),
)


def default_feeds(spark: SparkSession) -> DataFrame:
    """The registry (url, name) to begin with."""
    return spark.createDataFrame(list(DEFAULT_FEEDS), "url string, name string")


def feed_entries(spark: SparkSession, path: str, per_feed: int = 10) -> DataFrame:
    """feed, title, link, summary, published of the first entries of RSS (item) and Atom (entry) files, in file order."""
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    place = [F.col("_metadata.file_path").alias("feed"), F.monotonically_increasing_id().alias("pos"), "title"]
    rss = read("item", "title string, link string, description string, pubDate string")
    rss = rss.select(*place, "link", F.col("description").alias("summary"), F.col("pubDate").alias("published"))
    link = "array<struct<_VALUE: string, _href: string, _rel: string>>"
    atom = read("entry", f"title string, link {link}, summary string, content string, updated string, published string")
    told = F.element_at(F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), 1)["_href"]
    atom = atom.select(*place, F.when(F.size("link") > 0, told).alias("link"), F.coalesce("summary", "content").alias("summary"), F.coalesce("published", "updated").alias("published"))
    w = Window.partitionBy("feed").orderBy("pos")
    return rss.unionByName(atom).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= per_feed).drop("pos")


def add_feeds(feeds: DataFrame, new: DataFrame) -> DataFrame:
    """feeds (url, name) and those of new whose url they lack."""
    return feeds.unionByName(new.dropDuplicates(["url"]).join(feeds.select("url"), "url", "left_anti").select("url", "name"))


def remove_feed(feeds: DataFrame, url: str) -> DataFrame:
    return feeds.filter(F.col("url") != url)


def unprocessed(articles: DataFrame, processed: DataFrame) -> DataFrame:
    """Articles whose url was not processed, each url once."""
    return articles.join(processed.select("url"), "url", "left_anti").dropDuplicates(["url"])


def remember(processed: DataFrame, new: DataFrame, most: int = PROCESSED_KEPT) -> DataFrame:
    """The registry (url, ts) with new ones, the newest `most`."""
    every = processed.unionByName(new.select("url", "ts")).groupBy("url").agg(F.max("ts").alias("ts"))
    return every.orderBy(F.desc("ts"), "url").limit(most)


def lookup(entities: DataFrame, reference: DataFrame, most: int = 300) -> DataFrame:
    """entities (id) with summary and url from reference (id, summary, url)."""
    return entities.join(reference.select("id", F.substring("summary", 1, most).alias("summary"), "url"), "id", "left")


def news(articles: DataFrame, entity: str, now: Column, days: int = 7, most: int = 10) -> DataFrame:
    """The newest articles (title, url, ts) on an entity of the last 1 to 90 days."""
    recent = articles.filter(F.contains(F.lower("title"), F.lit(entity.lower())) & (F.datediff(now, F.col("ts")) <= max(1, min(90, days))))
    return recent.orderBy(F.desc("ts"), "url").limit(most)


def sanctioned(v: DataFrame, names: DataFrame) -> DataFrame:
    """id, entry: vertices whose id a list entry (name) equals or holds as a word."""
    words = names.select(F.col("name").alias("entry"), F.explode(F.array_distinct(F.concat(F.array(F.lower("name")), F.split(F.lower("name"), r"[^\w]+")))).alias("key"))
    return v.select("id", F.lower("id").alias("key")).join(words, "key").select("id", "entry").distinct()
