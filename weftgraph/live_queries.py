"""Registered queries of sources, streams and stores, and of what leaves the engine; and the same in SQL for DuckDB.

All read the given tables, or archives, feeds and batches that Spark makes of them.
"""

from __future__ import annotations

import json
import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph import vocab
from weftgraph.functions.extract import lexicon_extractor
from weftgraph.functions.text import strip_tags
from weftgraph.graph import Graph
from weftgraph.operators import analytics as A
from weftgraph.operators import paths as P
from weftgraph.operators import trees
from weftgraph.queries import BETWEEN, LABELS, TENSION, Query, graph_query
from weftgraph.sources import sinks, web
from weftgraph.sources.documents import SHORT_ARTICLE
from weftgraph.stage import new_path, stage, table
from weftgraph.streaming import outbox
from weftgraph.streaming.cycle import Cycle
from weftgraph.streaming.feeds import FeedIngest
from weftgraph.streaming.ingest import ingest_found
from weftgraph.streaming.store import GraphStore

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def tables(name: str, sql: str | None = None):
    def add(f: Query):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def graph(name: str, sql: str | None = None, *ctes: str, recursive: bool = False):
    def add(f):
        QUERIES[name], told = graph_query(f, sql, ctes, recursive)
        if told:
            SQL[name] = told
        return f

    return add


# -- pages and news as data sources ---------------------------------------------------------------


def _archive(pages: DataFrame, name: str) -> str:
    """An archive of pages (url, html); pages without html are HTTP 404."""
    folder = new_path(pages.sparkSession, name)
    answers = pages.filter("url is not null").groupBy("url").agg(F.max("html").alias("body"))
    web.archive(answers.withColumn("status", F.when(F.col("body").isNull(), 404).otherwise(200)), folder)
    return folder


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """All pages of the table, asked for in groups of a hundred, from an archive of them."""
    web.register(spark)
    pages = table(spark, sf, "pages")
    requests = new_path(spark, "requests")
    web.write_requests(pages, "url", requests)
    return spark.read.format("weft_pages").option("folder", _archive(pages, "archive")).option("requests", requests).load()


_ANSWERS = "(select url, max(html) as html from pages where url is not null group by url)"
tables("page_source", f"select url, case when html is null then 404 else 200 end as status, length(html) as chars, md5(html) as digest, case when html is null then 'HTTP 404' end as error from {_ANSWERS}")(
    lambda spark, sf: _pages(spark, sf).select("url", "status", F.length("html").cast("bigint").alias("chars"), F.md5("html").alias("digest"), "error")
)
tables("page_source_pushed", f"select url, length(html) as chars from {_ANSWERS} where url like 'https://m.%'")(
    lambda spark, sf: _pages(spark, sf).filter(F.startswith("url", F.lit("https://m."))).select("url", F.length("html").cast("bigint").alias("chars"))
)


@tables(
    "news_source",
    """select source as term, cast(place as int) as place, 'document ' || doc_id as title, 'https://news.example.com/' || doc_id as url, cast(doc_id as varchar) as seen, cast(null as varchar) as error
    from (select *, row_number() over (partition by source order by doc_id desc) as place from documents where source is not null) where place <= 10
    union all select 'nowhere', null, null, null, null, 'HTTP 404'""",
)
def _news(spark: SparkSession, sf: str) -> DataFrame:
    """The newest articles on each source of documents, from an archive of the service's answers; on one term it has none."""
    web.register(spark)
    docs = table(spark, sf, "documents").select(F.col("source").alias("term"), "doc_id").filter("term is not null")
    part = Window.partitionBy("term", F.pmod("doc_id", F.lit(64))).orderBy(F.desc("doc_id"))  # a third of all may have one source
    few = docs.withColumn("rn", F.row_number().over(part)).filter("rn <= 10")
    few = few.withColumn("rn", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("doc_id")))).filter("rn <= 10")
    day = F.date_format(F.timestamp_seconds(F.col("doc_id")), "yyyyMMdd'T'HHmmss'Z'")
    article = F.struct("rn", F.concat(F.lit("document "), "doc_id").alias("title"), F.concat(F.lit("https://news.example.com/"), "doc_id").alias("url"), day.alias("seendate"))
    body = F.to_json(F.struct(F.array_sort(F.collect_list(article)).alias("articles")))
    answers = few.groupBy("term").agg(body.alias("body")).select(web.news_url_column(F.col("term")).alias("url"), F.lit(200).alias("status"), "body")
    folder, requests = new_path(spark, "news"), new_path(spark, "terms")
    web.archive(answers, folder)
    web.write_requests(docs.select("term").unionByName(spark.createDataFrame([("nowhere",)], "term string")), "term", requests, 10)
    got = spark.read.format("weft_news").option("folder", folder).option("requests", requests).load()
    return got.select("term", "place", "title", "url", F.unix_timestamp("ts").cast("string").alias("seen"), "error")


# -- feeds ----------------------------------------------------------------------------------------

#: Pages of a feed, and entries of it that are read.
_PER_FEED, _ENTRIES = 20, 15
#: Characters that a page of the feeds must have, so that some have fewer.
_LONG = 2000


def _xml(c):
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _feed_ingest(spark: SparkSession, sf: str) -> FeedIngest:
    """Twenty pages of the table to a feed, in the order of their ids; one more feed is no feed."""
    pages = table(spark, sf, "pages").filter("url is not null")
    feed = F.concat(F.lit("https://feeds.example.com/"), F.floor(F.col("page_id") / _PER_FEED))
    item = F.concat(F.lit("<item><title>"), F.col("page_id").cast("string"), F.lit("</title><link>"), _xml(F.col("url")), F.lit("</link></item>"))
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", item.alias("item")))), lambda x: x["item"]), "")
    feeds = stage(pages.groupBy(feed.alias("url")).agg(items.alias("items")), "feeds")
    broken = spark.createDataFrame([("https://feeds.example.com/broken", "<html>")], "url string, html string")
    bodies = feeds.select("url", F.concat(F.lit("<rss><channel>"), "items", F.lit("</channel></rss>")).alias("html")).unionByName(broken)
    folder = _archive(pages.select("url", "html").unionByName(bodies), "feed-archive")
    registry = json.dumps([[r.url, r.url] for r in bodies.select("url").orderBy("url").collect()])  # a registry of feeds: one for every twenty pages
    root = new_path(spark, "feed-ingest")
    run = lexicon_extractor({"The": "organization", "Die": "country"}, {"und": "joins"})
    store = GraphStore(spark, f"{root}/store", buckets=8)
    options = {"folder": folder, "feeds": registry, "snapshots": f"{root}/snapshots", "every": "1", "entries": str(_ENTRIES), "group": "50"}
    return FeedIngest(store, FeedIngest.statuses(store, f"{root}/status"), run, options, text_of=strip_tags)


_STRIP = "trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\f\\r\\x0b]{2,}', ' ', 'g'))"


def _per_url(log: DataFrame) -> DataFrame:
    """poll, url, x: the status of each url at a poll, with its reason; where a further feed has the url too, it is skipped there without one."""
    rank = F.when(F.col("status") == "ok", 0).when(F.col("status") == "error", 1).otherwise(2)
    return log.groupBy("poll", "url").agg(F.min(F.struct(rank.alias("rank"), F.col("error").isNull().alias("bare"), "status", "error")).alias("x"))


@tables(
    "feed_statuses",
    f"""with told as (select *, row_number() over (partition by page_id // {_PER_FEED} order by page_id) as place from pages where url is not null),
    urls as (select url, count(distinct (page_id // {_PER_FEED}, page_id)) as entries from told where place <= {_ENTRIES} group by url),
    texts as (select url, {_STRIP} as text from {_ANSWERS}),
    first as (select url, case when text is null then 'error' when length(trim(text)) < {_LONG} then 'skipped' else 'ok' end as status,
      case when text is null then 'Fetch: HTTP 404' when length(trim(text)) < {_LONG} then 'Text too short' end as error, entries from urls join texts using (url))
    select 'first' as poll, status, error, count(*) as n from first group by all
    union all select 'second', case when status = 'ok' then 'skipped' else status end, case when status = 'ok' then null else error end, count(*) from first group by all
    union all select 'first', 'error', 'no feed', 1 union all select 'second', 'error', 'no feed', 1""",
)
def _feeds(spark: SparkSession, sf: str) -> DataFrame:
    """How many urls came to each status at two polls of all feeds: what was read once is skipped, what failed is tried again."""
    ingest = _feed_ingest(spark, sf)
    ingest.least = _LONG
    checkpoint = new_path(spark, "feed-checkpoint")
    for _ in range(2):
        time.sleep(1.1)  # the next poll is due
        query = ingest.start(checkpoint, every=None)
        query.awaitTermination()
        if query.exception():
            raise query.exception()
    log = ingest.log.read().withColumn("poll", F.when(F.col("batch") == 0, "first").otherwise("second"))
    return _per_url(log).groupBy("poll", "x.status", "x.error").agg(F.count(F.lit(1)).alias("n"))


@tables(
    "continuous_cycles",
    f"""with told as (select *, row_number() over (partition by page_id // {_PER_FEED} order by page_id) as place from pages where url is not null),
    texts as (select url, {_STRIP} as text from {_ANSWERS}),
    good as (select distinct url, text from told join texts using (url) where place <= {_ENTRIES} and length(trim(text)) >= {SHORT_ARTICLE})
    select c.cycle, cast(case when c.cycle = 1 then (select count(*) from good) else 0 end as bigint) as articles, false as failed, 5 as queries
    from (values (1::bigint), (2), (3)) c(cycle)""",
)
def _cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Three cycles over all feeds, the last after a restart, with what each has read, and how many queries it has asked."""
    checkpoint, root = new_path(spark, "cycle-checkpoint"), new_path(spark, "cycles")
    ingest = _feed_ingest(spark, sf)
    cycle = Cycle(ingest, checkpoint, root)
    for n in range(3):
        if n == 2:
            cycle = Cycle(ingest, checkpoint, root)
        time.sleep(1.1)
        query = cycle.once()
        query.awaitTermination()
        if query.exception():
            raise query.exception()
    asked = cycle.queries.read().groupBy("cycle").agg(F.count(F.lit(1)).cast("int").alias("queries"))
    return cycle.cycles.read().join(asked, "cycle").select("cycle", "articles", F.col("error").isNotNull().alias("failed"), "queries")


# -- the store ------------------------------------------------------------------------------------


@graph(
    "bucketed_upserts",
    """select src, dst, label, round(confidence, 2) as confidence, batch from (
      select *, row_number() over (partition by src, dst order by batch desc) as rn from (
        select src, dst, label, confidence, 0 as batch from e
        union all select src, dst, 'watches', 0.9, 1 from e where label = 'monitors' union all select src, dst, 'trusts', 0.8, 2 from e where label = 'cooperates with')) where rn = 1""",
)
def _bucketed(g: Graph) -> DataFrame:
    """The graph after two batches of relationships, each of which rewrites the buckets that it touches, with the version of each edge."""
    store = GraphStore(g.spark, new_path(g.spark, "buckets"), buckets=16)
    store.save(0, g, g.spark.createDataFrame([], "key string"))
    for batch, (old, new, confidence) in enumerate((("monitors", "watches", 0.9), ("cooperates with", "trusts", 0.8)), 1):
        at = store.load(0)[0].e.filter(F.col("label") == old)
        ends = F.create_map(F.lit("source"), "src", F.lit("target"), "dst")
        found = at.select(F.monotonically_increasing_id().alias("doc_id"), F.lit(1).alias("chunk"), F.lit(0).alias("pos"), F.lit(vocab.RELATIONSHIP).alias("class"), F.lit(new).alias("text"), ends.alias("attributes"), F.lit(confidence).alias("confidence"))
        ingest_found(store, found, batch)
    version = F.when(F.col("label") == "watches", 1).when(F.col("label") == "trusts", 2).otherwise(0)
    return store.load(2)[0].e.select("src", "dst", "label", F.round("confidence", 2).alias("confidence"), version.alias("batch"))


# -- alerts, webhooks, events ---------------------------------------------------------------------


def _mute(id_: str, event: str, payload: str) -> None:
    """A receiver that refuses what is about ids that end in 3."""
    if json.loads(payload)["entity"].endswith("3"):
        raise OSError("refused")


@graph(
    "alert_outbox",
    """select id as subject, case when id like '%3' then 'failed' else 'sent' end as status, case when id like '%3' then 2 else 1 end as tries, id like '%1' as acknowledged, round(score, 4) as score
    from tension where score >= 50""",
    TENSION,
)
def _alerts(g: Graph) -> DataFrame:
    """Countries of at least half of the tension as alerts: put twice under one batch, delivered once, some acknowledged."""
    hot = stage(A.country_tension(g).filter("score >= 50").select("id", F.lit(datetime(2024, 1, 1, tzinfo=timezone.utc)).alias("ts"), "score", "threshold"), "alerts")
    box = outbox.Outbox(g.spark, new_path(g.spark, "outbox"), tries=2, pause=0)
    for _ in range(2):
        box.put(0, outbox.alert_messages(hot, "test"))
    box.deliver(_mute)
    box.acknowledge(box.state().filter("subject like '%1'"))
    return box.state().select("subject", "status", "tries", "acknowledged", F.round(F.get_json_object("payload", "$.score").cast("double"), 4).alias("score"))


@tables("event_frames", "select cast(event_id as varchar) as id, event_type as event, props || chr(10) || cast(user_id as varchar) as data from events")
def _frames(spark: SparkSession, sf: str) -> DataFrame:
    """All events through a stream into files of server-sent events, and read back."""
    outbox.register(spark)
    at, out = new_path(spark, "events"), new_path(spark, "sse")
    rows = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("event"), F.concat_ws("\n", "props", F.col("user_id").cast("string")).alias("data"))
    rows.write.parquet(at)
    query = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1000).parquet(at).writeStream.format("weft_sse").option("checkpointLocation", new_path(spark, "sse-checkpoint")).trigger(availableNow=True).start(out)
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return outbox.sse_events(spark, out).select("id", "event", "data")


# -- briefs, bridges, removals --------------------------------------------------------------------

graph(
    "pdf_briefs",
    """select v.id, '# Knowledge graph brief' || chr(10) || '## ' || v.id || chr(10) || 'Type: ' || upper(v.grp) || ', confidence: ' || cast(round(v.confidence * 100) as int) || '%' || coalesce(chr(10) || 'Outgoing:' || chr(10) || o.lines, '') || coalesce(chr(10) || 'Incoming:' || chr(10) || i.lines, '') as text from v
    left join (select src as id, string_agg(src || ' → ' || label || ' → ' || dst, chr(10) order by dst) as lines from (select *, row_number() over (partition by src order by dst) as rn from e) where rn <= 8 group by src) o on o.id = v.id
    left join (select dst as id, string_agg(src || ' → ' || label || ' → ' || dst, chr(10) order by src) as lines from (select *, row_number() over (partition by dst order by src) as rn from e) where rn <= 8 group by dst) i on i.id = v.id
    where v.grp in ('country', 'organization')""",
)(lambda g: _briefs(g.staged()))


def _briefs(g: Graph) -> DataFrame:
    return sinks.pdf_text(sinks.pdf_briefs(g, g.v.filter("`group` in ('country', 'organization')")))


graph(
    "critical_edges",
    """select a, b, label, (select count(distinct component) from labels_) + 1 as components from lines l
    join (select least(src, dst) as a, greatest(src, dst) as b, min_by(label, src > dst) as label from e group by all) using (a, b)
    where not exists (select 1 from around r where r.a = l.a and r.b = l.b and r.id = l.b)""",
    LABELS,
    """lines as (select distinct least(src, dst) as a, greatest(src, dst) as b from e where src <> dst),
    around(a, b, id) as (select a, b, a from lines union select r.a, r.b, w.b from around r join both_ways w on w.a = r.id where not (least(w.a, w.b) = r.a and greatest(w.a, w.b) = r.b))""",
    recursive=True,
)(trees.critical_edges)

graph("orphaned_actors", "select id from (select src as id, dst as other from e union select dst, src from e) group by id having bool_and(other in ('NATION_6', id)) and id <> 'NATION_6'")(lambda g: P.orphaned(g, "NATION_6"))

_BETWEEN_2 = BETWEEN
for _name in ("arcs", "size_", "walk", "short", "sigma", "inner_", "bc"):
    _BETWEEN_2 = _BETWEEN_2.replace(f"{_name} ", f"{_name}2 ").replace(f"{_name}(", f"{_name}2(")
_BETWEEN_2 = _BETWEEN_2.replace(", size_)", ", size_2)").replace("from e ", "from e2 ").replace("from v)", "from v2)").replace("from v left", "from v2 v left")
graph(
    "centrality_shift",
    "select bc.id, round(bc.betweenness, 6) as before, round(bc2.betweenness, 6) as after, round(bc2.betweenness - bc.betweenness, 6) as delta from bc join bc2 using (id)",
    BETWEEN,
    "v2 as (select * from v where id <> 'NATION_6'), e2 as (select * from e where src <> 'NATION_6' and dst <> 'NATION_6')",
    _BETWEEN_2,
    recursive=True,
)(lambda g: P.centrality_shift(g.staged(), "NATION_6").select("id", *(F.round(c, 6).alias(c) for c in ("before", "after", "delta"))))


@graph("removal_effect")
def _effect(g: Graph) -> DataFrame:
    told = P.removal_effect(g.staged(), "NATION_6")
    return told.withColumns({c: F.transform(c, lambda x: x["id"]) for c in ("winners", "losers")})


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
