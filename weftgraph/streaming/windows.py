"""Rate limits, alerts and event-time windows, in batch and on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

LIMIT, SECONDS = 60, 60


def rate_violations(events: DataFrame, key: str, limit: int = LIMIT, seconds: int = SECONDS) -> DataFrame:
    """Events (key, ts) that are beyond `limit` in the last `seconds` of their key, with the number seen.

    All events count, rejected ones too; an event exactly `seconds` old counts. SlidingLimiter goes by the same rule.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("seen", F.count(F.lit(1)).over(w)).filter(F.col("seen") > limit)


class SlidingLimiter(StatefulProcessor):
    """Keeps the times of a key's events of the last `seconds`, no more than `limit`; rejects an event that `limit` others precede.

    A key that is idle for `idle` times as long in processing time is forgotten (None: never).
    """

    def __init__(self, limit: int = LIMIT, seconds: int = SECONDS, idle: int | None = 10) -> None:
        self.limit, self.seconds, self.idle = limit, seconds, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", "t double", ttlDurationMs=self.seconds * self.idle * 1000 if self.idle else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [t[0] for t in self.times.get()] if self.times.exists() else []
        for x in rows:
            x = x.sort_values("t")
            out = []
            for t in x["t"]:
                held = [h for h in held if h >= t - self.seconds]
                out.append(len(held) < self.limit)
                held = [*held, t][-self.limit :]  # the newest are enough to tell what comes
            yield pd.DataFrame({"key": [key[0]] * len(x), "t": x["t"], "admitted": out})
        if held:
            self.times.put([(t,) for t in held])
        else:
            self.times.clear()

    def close(self) -> None:
        pass


def limited(stream: DataFrame, limit: int = LIMIT, seconds: int = SECONDS, idle: int | None = 10) -> DataFrame:
    """key, t, admitted of a stream (key string, t seconds). Needs the RocksDB state store.

    For runs that take what is there and end (availableNow) pass idle=None: with a clock in its state a stream never ends.
    """
    return stream.groupBy("key").transformWithStateInPandas(SlidingLimiter(limit, seconds, idle), "key string, t double, admitted boolean", "Append", "ProcessingTime" if idle else "None")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes") -> DataFrame:
    """key, start, end, events of sessions that a gap parts. On streams give ts a watermark first."""
    s = events.withColumn("ts", F.col("ts").cast("timestamp"))
    out = s.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def windowed_counts(events: DataFrame, key: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by key and tumbling window of a stream (or table) with event times ts; late events drop."""
    s = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = s.groupBy(F.window("ts", size).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), key, "n")


def alerts(scores: DataFrame) -> DataFrame:
    """Rises to an alert: rows (id, ts, score, threshold) at or over the threshold whose predecessor was not."""
    w = Window.partitionBy("id").orderBy("ts")
    over = F.col("score") >= F.col("threshold")
    return scores.withColumn("over", over).withColumn("before", F.coalesce(F.lag("over").over(w), F.lit(False))).filter("over and not before").drop("over", "before")


def debounced(events: DataFrame, key: str, seconds: int = 30) -> DataFrame:
    """Events (key, ts) with no other of their key in the `seconds` before them."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy(key).orderBy(at)
    before = at - F.lag(at).over(w)
    return events.withColumn("gap", before).filter(F.col("gap").isNull() | (F.col("gap") >= seconds * 1_000_000)).drop("gap")
