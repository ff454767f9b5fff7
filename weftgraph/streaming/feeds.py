"""Feeds into the graph: each url once, and a status for each url and poll.

The stream `weft_feeds` gives entries; a micro-batch fetches the articles that were not yet read, extracts from them and changes
the graph. The status log is keyed by batch, the graph's versions too, and feeds are read from snapshots, so a batch that is run
again after a crash fetches, counts and changes the same: each url is ok once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftgraph import vocab
from weftgraph.functions.extract import Extractor, extract
from weftgraph.functions.text import article_text
from weftgraph.operators.mutate import Change, applied
from weftgraph.sources.documents import SHORT_ARTICLE
from weftgraph.sources.web import GROUP, answers_of, register
from weftgraph.stage import stage
from weftgraph.streaming.ingest import Update, ingest_found, owner_of
from weftgraph.streaming.store import BatchLog, GraphStore

STATUSES = "url string, title string, feed string, status string, error string, entities bigint, relations bigint, new_nodes bigint"
#: What is told of articles that are not read.
SHORT, FETCH, EXTRACT = "Text too short", "Fetch: ", "Extract: "


#: Groups of urls that a task fetches.
FETCHES = 5


def fetch_articles(urls: DataFrame, options: dict) -> DataFrame:
    """url, html, error of each url, from what answers the options name; by groups that are near each other in an archive."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answers = answers_of(options)
        for x in frames:
            every = x["url"].tolist()
            for i in range(0, len(every), GROUP):
                got = [(url, a.body, a.error) for url, a in answers.get(every[i : i + GROUP])]
                yield pd.DataFrame(got, columns=["url", "html", "error"])

    key = F.sha2("url", 256)
    dealt = urls.select("url").repartitionByRange(max(1, -(-urls.count() // (FETCHES * GROUP))), key).sortWithinPartitions(key)
    return dealt.mapInPandas(run, "url string, html string, error string")


@dataclass
class FeedIngest:
    """What a feed ingest reads with and writes to.

    options: for the formats of `sources.web` (feeds, snapshots, and folder or gateway if not the web). text_of: a page's text.
    """

    store: GraphStore
    log: BatchLog
    extractor: Extractor
    options: dict
    text_of: Callable[[Column], Column] = article_text
    update: Update = applied
    least: int = SHORT_ARTICLE
    owner: str = field(default="")

    @staticmethod
    def statuses(store: GraphStore, root: str) -> BatchLog:
        return BatchLog(store.spark, root, STATUSES)

    def entries(self) -> DataFrame:
        """The stream of entries."""
        register(self.store.spark)
        return self.store.spark.readStream.format("weft_feeds").options(**self.options).load()

    def batch(self, entries: DataFrame, batch: int) -> Change:
        """One batch of entries (feed, name, poll, place, title, link, error). An url that several entries have is read for the first of them."""
        self.store.before(batch, self.owner)
        rows = stage(entries.select("feed", F.coalesce("name", "feed").alias("name"), "place", F.coalesce("title", F.lit("")).alias("title"), "link", "error"), "feed-entries")
        failed = rows.filter("error is not null").select(F.col("feed").alias("url"), F.lit("").alias("title"), F.col("name").alias("feed"), F.lit("error").alias("status"), "error")
        told = rows.filter("error is null and link is not null")
        read = self.log.read(batch - 1).filter("status = 'ok'").select("url").distinct()
        first = told.groupBy(F.col("link").alias("url")).agg(F.min(F.struct("name", "feed", "place", "title")).alias("x"))
        first = stage(first.select("url", F.col("x.title").alias("title"), F.col("x.name").alias("feed")).join(read, "url", "left_anti"), "feed-new")
        known = told.select(F.col("link").alias("url"), "title", F.col("name").alias("feed")).distinct()
        known = known.join(first.withColumn("new", F.lit(True)), ["url", "title", "feed"], "left").filter("new is null")
        skipped = known.select("url", "title", "feed", F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("error"))

        got = stage(fetch_articles(first, self.options).withColumn("text", self.text_of(F.col("html"))).drop("html"), "feed-texts")
        short = F.length(F.trim(F.coalesce("text", F.lit("")))) < self.least
        docs = got.filter(F.col("error").isNull() & ~short).select(F.xxhash64("url").alias("doc_id"), "url", "text")
        found = stage(extract(docs.select("doc_id", "text"), self.extractor), "feed-found")
        faults = found.filter("parse_error is not null").groupBy("doc_id").agg(F.min("parse_error").alias("fault"))
        good = stage(found.join(faults, "doc_id", "left_anti").drop("parse_error"), "feed-items")
        change = ingest_found(self.store, good, batch, self.owner, self.update)

        relation = F.lower("class") == vocab.RELATIONSHIP
        counts = good.groupBy("doc_id").agg(F.count_if(~relation).alias("entities"), F.count_if(relation).alias("relations"))
        fresh = change.nodes_added.withColumnRenamed("id", "text").withColumn("is_new", F.lit(1))
        news = good.filter(~relation).select("doc_id", "text").distinct().join(fresh, "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("new_nodes"))
        judged = first.join(got, "url").withColumn("doc_id", F.xxhash64("url")).join(faults, "doc_id", "left").join(counts, "doc_id", "left").join(news, "doc_id", "left")
        status = F.when(F.col("error").isNotNull(), "error").when(short, "skipped").when(F.col("fault").isNotNull(), "error").otherwise("ok")
        why = F.when(F.col("error").isNotNull(), F.concat(F.lit(FETCH), "error")).when(short, F.lit(SHORT)).when(F.col("fault").isNotNull(), F.concat(F.lit(EXTRACT), "fault"))
        new = judged.select("url", "title", "feed", status.alias("status"), why.alias("error"), "entities", "relations", "new_nodes")
        none = [F.lit(None).cast("bigint").alias(c) for c in ("entities", "relations", "new_nodes")]
        every = new.unionByName(skipped.select("*", *none)).unionByName(failed.select("*", *none))
        self.log.write(batch, every.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("entities", "relations", "new_nodes")}))
        return change

    def start(self, checkpoint: str, every: str | None = "60 seconds") -> StreamingQuery:
        """Polls again and again; with every=None once."""
        self.owner = owner_of(self.store.spark, checkpoint)
        writer = self.entries().writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: self.batch(df, i) and None)
        return (writer.trigger(once=True) if every is None else writer.trigger(processingTime=every)).start()


def totals(log: DataFrame) -> DataFrame:
    """feed, ok, skipped, errors, entities, relations, new_nodes of a status log."""
    n = lambda s: F.count_if(F.col("status") == s)
    return log.groupBy("feed").agg(n("ok").alias("ok"), n("skipped").alias("skipped"), n("error").alias("errors"), *(F.sum(c).alias(c) for c in ("entities", "relations", "new_nodes")))
