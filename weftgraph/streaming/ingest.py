"""Streaming ingestion: chunks, extraction, deduplication and upserts by micro-batch; feeds read once per url."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftgraph.functions.extract import Extractor, extract, unseen
from weftgraph.graph import Graph
from weftgraph.operators.mutate import Change, applied, edges_of, named
from weftgraph.stage import stage
from weftgraph.streaming.store import Files, GraphStore


#: Partitions in which a batch's items are put in order; a batch's places are under 2^43.
_TASKS, _PLACES = 1000, 1 << 43

#: Makes a changed graph from what it touches of the old one, extractions (class, text, attributes, confidence, pos), and the ids
#: that their names mean (name, id).
Update = Callable[[Graph, DataFrame, DataFrame], Change]


def ingest_found(store: GraphStore, found: DataFrame, batch: int, owner: str = "", update: Update = applied) -> Change:
    """Extractions (doc_id, chunk, pos, ..., without faults) of one micro-batch into the store; only buckets they touch are rewritten.

    Names are resolved against the ids of all vertices; then only the buckets of what was named are read and written.
    """
    base = store.before(batch, owner)
    order = ["doc_id", "chunk", "pos"]
    items = stage(unseen(found, store.load(base)[1], order), "ingest-items")
    # numbers that rise in the order of batches, documents, chunks and items
    parts = min(_TASKS, int(store.spark.conf.get("spark.sql.shuffle.partitions")))
    placed = items.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    x = stage(placed.select("class", "text", "attributes", "confidence", (F.monotonically_increasing_id() + F.lit(batch * _PLACES)).alias("pos")), "ingest-placed")
    names = stage(named(store.part(base).v, x), "ingest-names")
    ends = edges_of(x, names)
    touched = store.touched(names.select("id"), ends)
    change = update(store.part(base, *touched), x, names)
    store.save(batch, change.graph, items.select("key"), touched, owner)
    return change


def ingest_batch(store: GraphStore, extractor: Extractor, docs: DataFrame, batch: int, on_change: Callable[[Change, DataFrame], None] | None = None, owner: str = "", update: Update = applied) -> Change:
    """One micro-batch of documents (doc_id, text) into the store. A chunk with a faulty answer adds nothing and is told.

    The change that is returned, and that on_change gets with the faults, has those parts of the graph that the batch touched.
    """
    store.before(batch, owner)
    found = stage(extract(docs, extractor), "ingest-found")
    change = ingest_found(store, found.filter("parse_error is null").drop("parse_error"), batch, owner, update)
    if on_change:
        on_change(change, found.filter("parse_error is not null").select("doc_id", "chunk", "parse_error"))
    return change


def owner_of(spark: SparkSession, checkpoint: str) -> str:
    """The name of a checkpoint: drawn once, and kept in it."""
    files = Files(spark, checkpoint)
    if (name := files.read("weftgraph-owner")) is None:
        files.write("weftgraph-owner", uuid.uuid4().hex)
        name = files.read("weftgraph-owner")
    return name


def ingest(stream: DataFrame, store: GraphStore, extractor: Extractor, checkpoint: str, once: bool = True, every: str = "60 seconds", on_change: Callable[[Change, DataFrame], None] | None = None, update: Update = applied) -> StreamingQuery:
    """Runs ingest_batch on a stream of documents: over what is there, or again and again."""
    owner = owner_of(store.spark, checkpoint)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: ingest_batch(store, extractor, df.select("doc_id", "text"), i, on_change, owner, update) and None)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def delta(change: Change) -> Graph:
    """The new vertices and the edges at them."""
    ids = change.nodes_added.select("id")
    g = change.graph
    e = g.e.join(ids.select(F.col("id").alias("src"), F.lit(True).alias("a")), "src", "left").join(ids.select(F.col("id").alias("dst"), F.lit(True).alias("b")), "dst", "left").filter("a or b")
    return Graph(g.v.join(ids, "id", "left_semi"), e.select(g.e.columns))


def once_per_url(articles: DataFrame, time: str = "ts", late: str = "7 days") -> DataFrame:
    """A stream of articles with each url once within the watermark."""
    return articles.withWatermark(time, late).dropDuplicatesWithinWatermark(["url"])


def statuses(articles: DataFrame, least: int = 200) -> DataFrame:
    """url, status: ok, or skipped for texts that are too short or missing."""
    short = F.coalesce(F.length(F.trim("text")), F.lit(0)) < least
    return articles.select("url", F.when(short, "skipped").otherwise("ok").alias("status"))


def feed_totals(results: DataFrame) -> DataFrame:
    """feed, ok, skipped, errors, entities, relations from article results (feed, status, entities, relations)."""
    n = lambda s: F.count_if(F.col("status") == s)
    return results.groupBy("feed").agg(n("ok").alias("ok"), n("skipped").alias("skipped"), n("error").alias("errors"), F.sum("entities").alias("entities"), F.sum("relations").alias("relations"))
