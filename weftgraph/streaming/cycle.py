"""The continuous cycle: poll feeds, change the graph, ask what its state suggests, and log it; started, stopped and asked for its status.

A cycle is a micro-batch. Its log is keyed by batch like the graph's versions, so a cycle that is run again after a crash is logged once,
and a restart goes on with the next one. An ingest that fails is told in the log, and the graph stays as it was.
"""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from weftgraph.plans import gql
from weftgraph.streaming.feeds import FeedIngest
from weftgraph.streaming.ingest import owner_of
from weftgraph.streaming.store import BatchLog

CYCLES = "cycle bigint, ts timestamp, elapsed_secs double, nodes bigint, edges bigint, articles bigint, entities bigint, relations bigint, error string"
QUERIES = "cycle bigint, place int, query string, kind string, rows bigint, error string"
#: Cycles and queries that a status tells, and the shortest interval in seconds.
CYCLES_TOLD, QUERIES_TOLD, LEAST_SECS = 20, 50, 60


class _Progress(StreamingQueryListener):
    """The state of one query, as Spark tells it."""

    def __init__(self) -> None:
        self.id, self.batch, self.ended, self.error = None, None, False, None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if str(event.progress.runId) == self.id:
            self.batch = event.progress.batchId

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) == self.id:
            self.ended, self.error = True, event.exception


class Cycle:
    """The cycle over a feed ingest; logs go beside its status log."""

    def __init__(self, ingest: FeedIngest, checkpoint: str, root: str, interval_secs: int = 300) -> None:
        spark = ingest.store.spark
        self.ingest, self.checkpoint, self.interval = ingest, checkpoint, max(LEAST_SECS, interval_secs)
        self.cycles, self.queries = BatchLog(spark, f"{root}/cycles", CYCLES), BatchLog(spark, f"{root}/queries", QUERIES)
        self.query: StreamingQuery | None = None
        self.listener: _Progress | None = None
        self.started_at = self.stopped_at = None

    def run(self, entries: DataFrame, batch: int) -> None:
        """One cycle."""
        began, now, spark, error = time.monotonic(), datetime.now(timezone.utc), entries.sparkSession, None
        store, n = self.ingest.store, batch + 1
        try:
            self.ingest.batch(entries, batch)
        except Exception as e:
            if store.newest() < batch:  # the graph as it was, under this cycle's number
                base = store.before(batch, self.ingest.owner)
                store.save(batch, store.part(base, set(), set()), spark.createDataFrame([], "key string"), (set(), set()), self.ingest.owner)
            error = str(e)[:1000]
        g, _ = store.load(batch)
        g = g.staged("cycle")
        asked = []
        for place, text in enumerate(gql.auto_queries(g, n), 1):
            told = gql.answer(g, text)
            asked.append((n, place, text, told.kind, told.count, told.error))
        own = self.ingest.log.read(batch).filter(F.col("batch") == batch)
        sums = own.agg(F.count_if(F.col("status") == "ok").alias("a"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("entities", "relations"))).first()
        row = (n, now, round(time.monotonic() - began, 1), g.v.count(), g.e.count(), sums.a, sums.entities, sums.relations, error)
        self.queries.write(batch, spark.createDataFrame(asked, QUERIES))
        self.cycles.write(batch, spark.createDataFrame([row], CYCLES))

    def _stream(self):
        self.ingest.owner = owner_of(self.ingest.store.spark, self.checkpoint)
        return self.ingest.entries().writeStream.option("checkpointLocation", self.checkpoint).foreachBatch(lambda df, i: self.run(df, i))

    def _begun(self, query: StreamingQuery) -> StreamingQuery:
        spark = self.ingest.store.spark
        self.query, self.started_at, self.stopped_at = query, datetime.now(timezone.utc), None
        self.listener = _Progress()
        self.listener.id = str(query.runId)
        spark.streams.addListener(self.listener)
        return query

    def active(self) -> bool:
        return self.query is not None and self.query.isActive

    def start(self) -> StreamingQuery:
        """Starts, or goes on after the last cycle; refused while it runs, and without feeds."""
        if self.active():
            raise ValueError("the cycle is running already")
        if self.ingest.options.get("feeds", "[]").strip() in ("", "[]"):
            raise ValueError("no feeds")
        return self._begun(self._stream().trigger(processingTime=f"{self.interval} seconds").start())

    def once(self) -> StreamingQuery:
        """One cycle, if a poll is due."""
        if self.active():
            raise ValueError("the cycle is running already")
        return self._begun(self._stream().trigger(once=True).start())

    def stop(self, wait_secs: float = 10) -> int:
        """Stops after what is running, and gives the number of cycles done."""
        if not self.active():
            raise ValueError("the cycle is not running")
        self.query.stop()
        self.query.awaitTermination(wait_secs)
        self.stopped_at = datetime.now(timezone.utc)
        self.ingest.store.spark.streams.removeListener(self.listener)
        return self.cycles.batches() + 1

    def status(self) -> dict:
        """What is running, totals over all cycles, and the newest cycles and queries."""
        cycles = self.cycles.read()
        sums = cycles.agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("articles", "entities", "relations"))).first()
        newest = cycles.drop("batch").orderBy(F.desc("cycle")).limit(CYCLES_TOLD).collect()
        asked = self.queries.read().drop("batch").orderBy(F.desc("cycle"), F.desc("place")).limit(QUERIES_TOLD).collect()
        return {
            "active": self.active(),
            "cycle": sums.n,
            "interval_secs": self.interval,
            "started_at": self.started_at,
            "stopped_at": self.stopped_at,
            "batch": self.listener.batch if self.listener else None,
            "error": self.listener.error if self.listener else None,
            "total_articles": sums.articles,
            "total_entities": sums.entities,
            "total_relations": sums.relations,
            "nodes": newest[0].nodes if newest else 0,
            "edges": newest[0].edges if newest else 0,
            "cycle_log": [r.asDict() for r in newest],
            "query_log": [r.asDict() for r in asked],
        }
