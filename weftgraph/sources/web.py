"""Pages, news and feeds as data sources: `spark.read.format("weft_pages")`, `"weft_news"`, and the stream `"weft_feeds"`.

Requests are planned in bounded groups, a partition for each, and a request that fails is a row with an error. What answers a
request is chosen by options: the web (urls and redirects are checked), `gateway` (an address that urls are handed to), or
`folder` (an archive of answers that `archive` writes, for replays and for machines without a network).

Requests come from the option `urls` or `terms` (a JSON array), or from `requests`, a folder of JSON lines that `write_requests`
makes, where a file is a group; so the driver lists files and never holds the requests. Filters on the column of requests
are pushed: what they exclude is not asked for. `register` makes the formats known to a session.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, StringStartsWith
from pyspark.sql.types import StructType

from weftgraph.sources.documents import blocked_host

GROUP, MOST_BYTES, TIMEOUT = 100, 10 << 20, 15
#: News: the most articles of a term, and the days that may be asked for.
NEWS_ROWS, NEWS_DAYS = 10, (1, 90)
# Fixed value: the form of a request to the public news service.
NEWS_ENDPOINT = "https://api.gdeltproject.org/api/v2/doc/doc?query=%22{term}%22%20sourcelang:English&mode=artlist&maxrecords={rows}&format=json&timespan={days}d&sort=DateDesc"
ANSWERS = "key string, url string, status int, body string"


def register(spark: SparkSession) -> None:
    """Makes the formats known, and lets filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (PageSource, NewsSource, FeedSource):
        spark.dataSource.register(source)


# -- what answers requests ------------------------------------------------------------------------


#: Bytes of the blocks of an archive's files: a reader holds one at a time.
BLOCK = 8 << 20


def archive(answers: DataFrame, folder: str) -> None:
    """Writes answers (url, status, body) so that a task finds those of a group: sorted by a digest of the url."""
    rows = answers.select(F.sha2("url", 256).alias("key"), "url", F.col("status").cast("int").alias("status"), "body")
    rows.filter("url is not null").repartitionByRange("key").sortWithinPartitions("key").write.option("parquet.block.size", BLOCK).parquet(folder)


def write_requests(df: DataFrame, column: str, folder: str, group: int = GROUP) -> None:
    """Writes distinct requests as JSON lines, at most `group` to a file, near ones of an archive together."""
    rows = df.select(column).filter(F.col(column).isNotNull()).distinct()
    key = F.sha2(column, 256)
    rows.repartitionByRange(key).sortWithinPartitions(key).write.option("maxRecordsPerFile", group).json(folder)


@dataclass(frozen=True)
class Answer:
    status: int | None
    body: str | None
    error: str | None


def _reason(e: Exception) -> str:
    return str(e)[:300] or type(e).__name__


class Web:
    """Answers from the web: http and https only, no private address, redirects checked."""

    def __init__(self, timeout: float = TIMEOUT) -> None:
        self.timeout = timeout

    def request(self, url: str) -> urllib.request.OpenerDirector:
        from weftgraph.sources.fetch import _Checked, check_url

        check_url(url)
        return urllib.request.build_opener(_Checked).open(url, timeout=self.timeout)

    def one(self, url: str) -> Answer:
        try:
            with self.request(url) as r:
                return Answer(r.status, r.read(MOST_BYTES).decode(r.headers.get_content_charset() or "utf-8", "ignore"), None)
        except urllib.error.HTTPError as e:
            return Answer(e.code, None, f"HTTP {e.code}")
        except Exception as e:  # one request's failure is its own
            return Answer(None, None, _reason(e))

    def get(self, urls: list[str]) -> Iterator[tuple[str, Answer]]:
        for url in urls:
            yield url, self.one(url)


class Gateway(Web):
    """Answers of an address that is trusted; urls are handed to it as a parameter, and checked as text."""

    def __init__(self, address: str, timeout: float = TIMEOUT) -> None:
        super().__init__(timeout)
        self.address = address

    def request(self, url: str):
        parts = urllib.parse.urlsplit(url)
        if parts.scheme not in ("http", "https") or not parts.hostname or blocked_host(parts.hostname):
            raise ValueError("url not allowed")
        return urllib.request.urlopen(f"{self.address}?url={urllib.parse.quote(url, safe='')}", timeout=self.timeout)


class Folder:
    """Answers of an archive; a url that it lacks is HTTP 404. Blocks whose keys can be asked for are read, one at a time."""

    def __init__(self, folder: str) -> None:
        self.folder, self.data = folder, None

    def get(self, urls: list[str]) -> Iterator[tuple[str, Answer]]:
        import pyarrow as pa
        import pyarrow.dataset as ds

        if self.data is None:  # files are listed once, not for each group
            self.data = ds.dataset(self.folder, format="parquet")
        keys = {hashlib.sha256(u.encode()).hexdigest(): u for u in urls}
        found = {}
        if keys:
            there = ds.field("key").isin(list(keys))
            near = there & (ds.field("key") >= min(keys)) & (ds.field("key") <= max(keys))
            scan = ds.ParquetFragmentScanOptions(use_buffered_stream=True, pre_buffer=False)
            batches = self.data.to_batches(filter=near, columns=["key", "status", "body"], batch_size=256, batch_readahead=0, fragment_readahead=1, fragment_scan_options=scan, use_threads=False)
            for batch in batches:
                for key, status, body in zip(*(batch.column(c).to_pylist() for c in ("key", "status", "body"))):
                    found[keys[key]] = Answer(status, body, None) if (status or 200) < 400 else Answer(status, None, f"HTTP {status}")
        pa.default_memory_pool().release_unused()
        for url in urls:
            yield url, found.get(url, Answer(404, None, "HTTP 404"))


def answers_of(options: dict) -> Web | Folder:
    if options.get("folder"):
        return Folder(options["folder"])
    timeout = float(options.get("timeout", TIMEOUT))
    return Gateway(options["gateway"], timeout) if options.get("gateway") else Web(timeout)


# -- groups of requests ---------------------------------------------------------------------------


@dataclass
class Group(InputPartition):
    """Requests, or the file that has them."""

    requests: tuple[str, ...] = ()
    file: str | None = None


def _open(path: str):
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store, at


class Wanted:
    """The requests that pushed filters leave."""

    def __init__(self, column: str) -> None:
        self.column, self.tests = column, []

    def push(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes filters on the column of requests; gives back the others."""
        for f in filters:
            if f.attribute != (self.column,) if hasattr(f, "attribute") else True:
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append(frozenset([f.value]))
            elif isinstance(f, In):
                self.tests.append(frozenset(f.value))
            elif isinstance(f, StringStartsWith):
                self.tests.append(f.value)
            else:
                yield f

    def __call__(self, request: str) -> bool:
        return all(request.startswith(t) if isinstance(t, str) else request in t for t in self.tests)


class _Requests(DataSourceReader):
    """Groups of requests, from an option or a folder."""

    def __init__(self, options: dict, column: str, option: str) -> None:
        self.options, self.column, self.option = dict(options), column, option
        self.size, self.wanted = int(options.get("group", GROUP)), Wanted(column)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        yield from self.wanted.push(filters)

    def partitions(self) -> list[InputPartition]:
        if folder := self.options.get("requests"):
            from pyarrow import fs

            store, at = _open(folder)
            found = store.get_file_info(fs.FileSelector(at, recursive=True))
            return [Group(file=f"{folder.split('://')[0]}://{f.path}" if "://" in folder else f.path) for f in found if f.is_file and f.size and f.base_name[0] not in "._"] or [Group()]
        every = [x for x in dict.fromkeys(json.loads(self.options.get(self.option, "[]"))) if self.wanted(x)]
        return [Group(tuple(every[i : i + self.size])) for i in range(0, len(every), self.size)] or [Group()]

    def groups(self, part: Group) -> Iterator[list[str]]:
        """The requests of a partition, `size` at a time."""
        if part.file is None:
            if part.requests:
                yield list(part.requests)
            return
        store, at = _open(part.file)
        held: list[str] = []
        with store.open_input_stream(at) as f:
            import io

            for line in io.TextIOWrapper(f, "utf-8", newline="\n"):
                request = json.loads(line).get(self.column) if line.strip() else None
                if request is not None and self.wanted(request):
                    held.append(request)
                if len(held) == self.size:
                    yield held
                    held = []
        if held:
            yield held


# -- pages ----------------------------------------------------------------------------------------


class PageReader(_Requests):
    def read(self, partition: Group) -> Iterator[tuple]:
        answers = answers_of(self.options)
        for urls in self.groups(partition):
            for url, a in answers.get(urls):
                yield url, a.status, a.body, a.error


class PageSource(DataSource):
    """url, status, html, error of pages; null html where error tells why."""

    @classmethod
    def name(cls) -> str:
        return "weft_pages"

    def schema(self) -> str:
        return "url string, status int, html string, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PageReader(self.options, "url", "urls")


# -- news -----------------------------------------------------------------------------------------


def news_url(term: str, days: int = 7, endpoint: str = NEWS_ENDPOINT) -> str:
    low, high = NEWS_DAYS
    return endpoint.format(term=urllib.parse.quote(term, safe=""), rows=NEWS_ROWS, days=max(low, min(high, days)))


def news_url_column(term: Column, days: int = 7, endpoint: str = NEWS_ENDPOINT) -> Column:
    """news_url of a column, for archives."""
    before, after = endpoint.replace("{rows}", str(NEWS_ROWS)).replace("{days}", str(max(NEWS_DAYS[0], min(NEWS_DAYS[1], days)))).split("{term}")
    return F.concat(F.lit(before), F.replace(F.url_encode(term), F.lit("+"), F.lit("%20")), F.lit(after))


def _when(text) -> datetime | None:
    for form in ("%Y%m%dT%H%M%SZ", "%Y-%m-%dT%H:%M:%SZ"):
        try:
            return datetime.strptime(str(text), form).replace(tzinfo=timezone.utc)
        except ValueError:
            pass
    return None


class NewsReader(_Requests):
    """A request for each term. A lower bound of ts that is pushed leaves older articles out where they are read."""

    def __init__(self, options: dict) -> None:
        super().__init__(options, "term", "terms")
        self.since: datetime | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in self.wanted.push(filters):
            if isinstance(f, GreaterThanOrEqual) and f.attribute == ("ts",) and isinstance(f.value, datetime):
                self.since = max(filter(None, (self.since, f.value.astimezone(timezone.utc))))
            else:
                yield f

    def read(self, partition: Group) -> Iterator[tuple]:
        answers, days = answers_of(self.options), int(self.options.get("days", 7))
        for terms in self.groups(partition):
            by_url = {news_url(t, days, self.options.get("endpoint", NEWS_ENDPOINT)): t for t in terms}
            for url, a in answers.get(list(by_url)):
                term, error, articles = by_url[url], a.error, []
                if error is None:
                    try:
                        articles = json.loads(a.body)["articles"][:NEWS_ROWS]
                    except (ValueError, KeyError, TypeError):
                        error = "no articles in the answer"
                if error is not None:
                    if self.since is None:
                        yield term, None, None, None, None, error
                    continue
                for place, x in enumerate(articles, 1):
                    if isinstance(x, dict):
                        ts = _when(x.get("seendate"))
                        if self.since is None or ts is not None and ts >= self.since:
                            yield term, place, x.get("title"), x.get("url"), ts, None


class NewsSource(DataSource):
    """term, place, title, url, ts, error of the newest articles on terms; one row with an error where a request failed."""

    @classmethod
    def name(cls) -> str:
        return "weft_news"

    def schema(self) -> str:
        return "term string, place int, title string, url string, ts timestamp, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return NewsReader(self.options)


# -- feeds ----------------------------------------------------------------------------------------


def _child(node: ElementTree.Element, *names: str) -> str | None:
    """The text of the first child of one of these names, in any namespace."""
    for name in names:
        for x in node:
            if x.tag.rpartition("}")[2] == name:
                text = "".join(x.itertext()).strip()
                if text:
                    return text
    return None


def _link(node: ElementTree.Element) -> str | None:
    for x in node:
        if x.tag.rpartition("}")[2] == "link":
            href = x.get("href")
            if href is None or x.get("rel", "alternate") == "alternate":
                return (href or x.text or "").strip() or None
    return None


def entries(body: str, most: int) -> list[tuple]:
    """place, title, link, summary, published of the first entries of an RSS or Atom feed; raises where it is none."""
    try:
        root = ElementTree.fromstring(body.encode())
    except ElementTree.ParseError:
        raise ValueError("no feed") from None
    if root.tag.rpartition("}")[2].lower() not in ("rss", "feed", "rdf"):
        raise ValueError("no feed")
    found = [x for x in root.iter() if x.tag.rpartition("}")[2] in ("item", "entry")][:most]
    return [(i, _child(x, "title"), _link(x), _child(x, "description", "summary", "content"), _child(x, "pubDate", "published", "updated", "date")) for i, x in enumerate(found, 1)]


@dataclass
class Poll(InputPartition):
    feeds: tuple[tuple[str, str], ...]
    number: int


class FeedStream(DataSourceStreamReader):
    """A batch is a poll of all feeds, numbered by the clock. What a feed said at a poll is kept under `snapshots` before it is
    used, so a batch that is run again, after a restart or by a second attempt, has the same rows."""

    def __init__(self, options: dict) -> None:
        self.options, self.every = dict(options), max(1, int(options.get("every", 60)))
        self.size, self.most = int(options.get("group", 20)), int(options.get("entries", 5))
        if "snapshots" not in options:
            raise ValueError("name a folder that all machines share in the option snapshots")

    def _feeds(self) -> list[tuple[str, str]]:
        """The registry as it is now: a JSON array of [url, name], or a file with one."""
        told = self.options.get("feeds", "[]")
        if not told.lstrip().startswith("["):
            store, at = _open(told)
            with store.open_input_stream(at) as f:
                told = f.read().decode()
        return [(str(u), str(n or u)) for u, n in json.loads(told)]

    def initialOffset(self) -> dict:
        return {"poll": 0}

    def latestOffset(self) -> dict:
        return {"poll": int(time.time() // self.every)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        feeds = self._feeds() if end["poll"] > start["poll"] else []
        feeds.sort(key=lambda x: hashlib.sha256(x[0].encode()).digest())  # those of a task are near each other in an archive
        return [Poll(tuple(feeds[i : i + self.size]), end["poll"]) for i in range(0, len(feeds), self.size)]

    def _path(self, url: str, number: int) -> str:
        return f"{self.options['snapshots'].rstrip('/')}/poll{number:012d}/{hashlib.sha256(url.encode()).hexdigest()}.json"

    def _keep(self, url: str, number: int, a: Answer) -> None:
        """Writes what a feed said, unless another attempt did."""
        from pyarrow import fs

        store, at = _open(self._path(url, number))
        store.create_dir(at.rpartition("/")[0], recursive=True)
        new = f"{at}.{uuid.uuid4().hex}"
        with store.open_output_stream(new) as f:
            f.write(json.dumps([a.status, a.body, a.error]).encode())
        if store.get_file_info(at).type == fs.FileType.NotFound:
            store.move(new, at)
        else:
            store.delete_file(new)

    def read(self, partition: Poll) -> Iterator[tuple]:
        from pyarrow import fs

        missing = []
        for url, _ in partition.feeds:
            store, at = _open(self._path(url, partition.number))
            if store.get_file_info(at).type == fs.FileType.NotFound:
                missing.append(url)
        if missing:  # together: an archive is opened once for all of them
            for url, a in answers_of(self.options).get(list(dict.fromkeys(missing))):
                self._keep(url, partition.number, a)
        for url, name in partition.feeds:
            store, at = _open(self._path(url, partition.number))
            with store.open_input_stream(at) as f:
                a = Answer(*json.loads(f.read()))
            error, found = a.error, []
            if error is None:
                try:
                    found = entries(a.body, self.most)
                except Exception as e:  # one feed's failure is its own
                    error = _reason(e)
            if error is not None:
                yield url, name, partition.number, 0, None, None, None, None, error
            for x in found:
                yield url, name, partition.number, *x, None

    def commit(self, end: dict) -> None:
        """Drops snapshots of polls long done; the newest hundred stay."""
        from pyarrow import fs

        store, at = _open(self.options["snapshots"])
        found = sorted(f.base_name for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.base_name.startswith("poll"))
        for old in found[:-100]:
            if int(old[4:]) < end["poll"]:
                store.delete_dir(f"{at.rstrip('/')}/{old}")


class FeedSource(DataSource):
    """feed, name, poll, place, title, link, summary, published, error: the first entries of each feed at each poll, and a row with
    an error (place 0) where a feed failed."""

    @classmethod
    def name(cls) -> str:
        return "weft_feeds"

    def schema(self) -> str:
        return "feed string, name string, poll bigint, place int, title string, link string, summary string, published string, error string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FeedStream(self.options)
