"""What leaves the engine: alerts and changes as messages, their log, webhooks, and a stream sink of server-sent events.

A message is put into the outbox under its batch, so a batch that is run again puts it there once. A delivery first claims what
it will send, then sends, then logs the outcome. A claim without an outcome is of a delivery that died: its messages may
have been sent, so they are held, told as in doubt, and sent again only if that is asked for. Each carries its id as an
idempotency key, for receivers that drop what they have. Attempts are bounded, in a delivery and in all.
"""

from __future__ import annotations

import json
import os
import time
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from weftgraph.graph import Graph
from weftgraph.stage import stage
from weftgraph.streaming.store import BatchLog

#: Takes a message's id, event and payload, and raises where it isn't delivered.
Sender = Callable[[str, str, str], None]
TRIES, TRIES_IN_ALL, PAUSE_SECS = 3, 9, 0.5


def webhook(urls: dict[str, list[str]], timeout: float = 10) -> Sender:
    """A sender that posts a message to all urls of its event; those of `*` get every message."""

    def send(id_: str, event: str, payload: str) -> None:
        for url in [*urls.get(event, []), *urls.get("*", [])]:
            body = json.dumps({"id": id_, "event": event, "data": json.loads(payload)}).encode()
            request = urllib.request.Request(url, body, {"Content-Type": "application/json", "Idempotency-Key": id_})
            with urllib.request.urlopen(request, timeout=timeout) as r:
                r.read()

    return send


class Outbox:
    """Messages (event, subject, payload), what became of them, and who has seen them."""

    def __init__(self, spark: SparkSession, root: str, tries: int = TRIES, tries_in_all: int = TRIES_IN_ALL, pause: float = PAUSE_SECS) -> None:
        self.spark, self.tries, self.tries_in_all, self.pause = spark, tries, tries_in_all, pause
        self.queue = BatchLog(spark, f"{root}/queue", "id string, event string, subject string, payload string, ts timestamp")
        self.claims = BatchLog(spark, f"{root}/claims", "id string")
        self.outcomes = BatchLog(spark, f"{root}/outcomes", "id string, status string, tries int, error string")
        self.seen = BatchLog(spark, f"{root}/acknowledged", "id string")

    def put(self, batch: int, messages: DataFrame) -> None:
        """Puts a batch's messages (event, subject, payload as JSON, ts); of those that agree in batch, event and subject one."""
        id_ = F.sha2(F.concat_ws("\n", F.lit(str(batch)), "event", "subject"), 256).alias("id")
        rows = messages.select(id_, "event", "subject", "payload", F.col("ts").cast("timestamp").alias("ts"))
        first = rows.groupBy("id").agg(F.min(F.struct("event", "subject", "payload", "ts")).alias("x"))
        self.queue.write(batch, first.select("id", "x.*"))

    def state(self) -> DataFrame:
        """id, event, subject, payload, ts, status (waiting, sent, failed, dead or in doubt), tries, error, acknowledged of each message."""
        tried = self.outcomes.read().groupBy("id").agg(F.sum("tries").cast("int").alias("tries"), F.max_by(F.struct("status", "error"), "batch").alias("x"), F.max("batch").alias("told"))
        claimed = self.claims.read().groupBy("id").agg(F.max("batch").alias("claimed"))
        seen = self.seen.read().select("id").distinct().withColumn("acknowledged", F.lit(True))
        rows = self.queue.read().drop("batch").join(tried, "id", "left").join(claimed, "id", "left").join(seen, "id", "left")
        doubt = F.col("claimed").isNotNull() & (F.col("told").isNull() | (F.col("told") < F.col("claimed")))
        status = F.when(F.col("x.status") == "sent", "sent").when(doubt, "in doubt").when(F.col("tries") >= self.tries_in_all, "dead").otherwise(F.coalesce("x.status", F.lit("waiting")))
        return rows.select("id", "event", "subject", "payload", "ts", status.alias("status"), F.coalesce("tries", F.lit(0)).alias("tries"), F.col("x.error").alias("error"), F.coalesce("acknowledged", F.lit(False)).alias("acknowledged"))

    def deliver(self, send: Sender, in_doubt: bool = False) -> DataFrame:
        """Sends what waits or failed before, tasks side by side; id, status, tries, error of what was tried.

        in_doubt: also what an earlier delivery may have sent.
        """
        number = max(self.claims.batches(), self.outcomes.batches()) + 1
        wanted = ["waiting", "failed", *(["in doubt"] if in_doubt else [])]
        due = stage(self.state().filter(F.col("status").isin(wanted)).select("id", "event", "payload", "tries"), "outbox-due")
        self.claims.write(number, due.select("id"))
        tries, in_all, pause = self.tries, self.tries_in_all, self.pause

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in frames:
                out = []
                for id_, event, payload, before in zip(x["id"], x["event"], x["payload"], x["tries"]):
                    error, n = None, 0
                    for n in range(1, min(tries, in_all - before) + 1):
                        try:
                            send(id_, event, payload)
                            error = None
                            break
                        except Exception as e:
                            error = str(e)[:300] or type(e).__name__
                            time.sleep(pause * 2 ** (n - 1) if n < tries else 0)
                    out.append((id_, "sent" if error is None else "failed", n, error))
                yield pd.DataFrame(out, columns=["id", "status", "tries", "error"])

        self.outcomes.write(number, due.mapInPandas(run, "id string, status string, tries int, error string"))
        return self.outcomes.read().filter(F.col("batch") == number).drop("batch")

    def acknowledge(self, ids: DataFrame) -> None:
        self.seen.write(self.seen.batches() + 1, ids.select("id"))

    def since(self, batch: int) -> DataFrame:
        """Messages of later batches, for readers that keep their own place."""
        return self.queue.read().filter(F.col("batch") > batch)


def alert_messages(alerts: DataFrame, source: str = "") -> DataFrame:
    """Messages of alerts (id, ts, score, threshold)."""
    payload = F.to_json(F.struct(F.col("id").alias("entity"), "score", "threshold", F.lit(source).alias("trigger_source")))
    return alerts.select(F.lit("tension_threshold_crossed").alias("event"), F.col("id").alias("subject"), payload.alias("payload"), "ts")


def delta_messages(delta: Graph, ts) -> DataFrame:
    """Messages of a change's new vertices and the edges at them."""
    nodes = delta.v.select(F.lit("node_added").alias("event"), F.col("id").alias("subject"), F.to_json(F.struct("id", "group", "confidence")).alias("payload"))
    edges = delta.e.select(F.lit("edge_added").alias("event"), F.concat_ws(">", "src", "dst").alias("subject"), F.to_json(F.struct("src", "dst", "label", "confidence")).alias("payload"))
    return nodes.unionByName(edges).withColumn("ts", F.lit(ts))


# -- server-sent events ---------------------------------------------------------------------------


def sse_frame(id_: str | None, event: str | None, data: str | None) -> str:
    """One event in the text form of server-sent events."""
    head = "".join(f"{k}: {' '.join(v.splitlines())}\n" for k, v in (("id", id_), ("event", event)) if v)
    return head + "".join(f"data: {line}\n" for line in (data or "").split("\n")) + "\n"


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    events: int


class SseWriter(DataSourceStreamWriter):
    """Files of events, a folder for each batch. A task writes its file aside; the driver moves them in when all are there, and drops
    what a batch that was done already writes again. Readers wait for a folder's `DONE`."""

    def __init__(self, options: dict) -> None:
        self.folder = options["path"].rstrip("/")

    def _open(self, name: str):
        from weftgraph.sources.web import _open

        return _open(f"{self.folder}/{name}")

    def write(self, iterator: Iterator) -> Written:
        name, n = None, 0
        frames = (sse_frame(r["id"], r["event"], r["data"]) for r in iterator)
        first = next(frames, None)
        if first is not None:
            name = uuid.uuid4().hex
            store, at = self._open(f".aside/{name}")
            store.create_dir(os.path.dirname(at), recursive=True)
            with store.open_output_stream(at) as f:
                f.write(first.encode())
                n = 1
                for frame in frames:
                    f.write(frame.encode())
                    n += 1
        return Written(name, n)

    def commit(self, messages: list, batchId: int) -> None:
        from pyarrow import fs

        store, at = self._open(f"batch={batchId:012d}")
        done = store.get_file_info(f"{at}/DONE").type != fs.FileType.NotFound
        if done:
            return self.abort(messages, batchId)
        if store.get_file_info(at).type != fs.FileType.NotFound:
            store.delete_dir(at)  # of a commit that died
        store.create_dir(at, recursive=True)
        for i, m in enumerate(x for x in messages if x is not None and x.name):
            store.move(self._open(f".aside/{m.name}")[1], f"{at}/part-{i:05d}.sse")
        with store.open_output_stream(f"{at}/DONE") as f:
            f.write(str(sum(m.events for m in messages if m is not None)).encode())

    def abort(self, messages: list, batchId: int) -> None:
        from pyarrow import fs

        for m in messages:
            if m is not None and m.name:
                store, at = self._open(f".aside/{m.name}")
                if store.get_file_info(at).type != fs.FileType.NotFound:
                    store.delete_file(at)


class SseSink(DataSource):
    """`df.writeStream.format("weft_sse").start(path)` for rows of id, event and data."""

    @classmethod
    def name(cls) -> str:
        return "weft_sse"

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        if not {"id", "event", "data"} <= set(schema.fieldNames()):
            raise ValueError("rows need id, event and data")
        return SseWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SseSink)


def sse_events(spark: SparkSession, folder: str) -> DataFrame:
    """batch, id, event, data: finished batches of a sink, read back."""
    read = spark.read.option("lineSep", "\n\n").option("pathGlobFilter", "*.sse").option("recursiveFileLookup", True)
    texts = read.text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("frame"))
    done = spark.read.format("binaryFile").option("pathGlobFilter", "DONE").option("recursiveFileLookup", True).load(folder)
    number = lambda c: F.regexp_extract(c, r"batch=(\d+)/", 1).cast("bigint")
    frames = texts.filter("frame <> ''").select(number(F.col("path")).alias("batch"), "frame")
    field = lambda k: F.nullif(F.regexp_extract("frame", rf"(?m)^{k}: (.*)$", 1), F.lit(""))
    data = F.array_join(F.transform(F.filter(F.split("frame", "\n"), lambda x: F.startswith(x, F.lit("data: "))), lambda x: F.substr(x, F.lit(7))), "\n")
    ended = done.select(number(F.col("path")).alias("batch")).distinct()
    return frames.join(F.broadcast(ended) if ended.count() <= 100_000 else ended, "batch").select("batch", field("id").alias("id"), field("event").alias("event"), data.alias("data"))
