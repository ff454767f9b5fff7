"""Decay, staleness, lifecycles, trends and source quality of entities and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph import vocab


def decayed(confidence: Column, days: Column, sources: Column, rate: float = 0.1, floor: float = 0.1) -> Column:
    """Confidence after so many days: exponential by months (30 days), slower with more sources, 3 places, floored."""
    n = F.greatest(F.coalesce(sources, F.lit(1)), F.lit(1))
    return F.greatest(F.lit(floor), F.round(confidence * F.exp(-rate / F.log(1 + n) * days / 30), 3))


def stale(confidence: Column, least: float = 0.4) -> Column:
    return confidence < least


def lifecycle(mentions: DataFrame, now: Column, dormant_days: int = 30) -> DataFrame:
    """id, first_seen, last_seen, mentions, dormant from mentions (id, ts)."""
    seen = mentions.groupBy("id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("mentions"))
    return seen.withColumn("dormant", F.datediff(now, F.col("last_seen")) > dormant_days)


def staleness(edges: DataFrame, now: Column, days: int = 60) -> DataFrame:
    """edges (with last_confirmed or first_seen) with staleness_days and is_stale."""
    age = F.datediff(now, F.coalesce("last_confirmed", "first_seen"))
    return edges.withColumns({"staleness_days": age, "is_stale": age > days})


def trajectory(points: DataFrame, least: int = 3, slope: float = 0.02) -> DataFrame:
    """id, n, slope, trend from points (id, ts, value): the last less the first, by steps; no trend below `least` points."""
    ends = points.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min_by("value", "ts").alias("first"), F.max_by("value", "ts").alias("last"))
    s = (F.col("last") - F.col("first")) / F.greatest(F.col("n") - 1, F.lit(1))
    ends = ends.withColumn("slope", s)
    trend = F.when(F.col("slope") > slope, "rising").when(F.col("slope") < -slope, "falling").otherwise("stable")
    return ends.filter(F.col("n") >= least).select("id", "n", F.round("slope", 6).alias("slope"), trend.alias("trend"))


def edge_credibility(sources: Column) -> Column:
    """From 0.5 up by 0.15 for each source, and by a tenth of the known domains' quality; 1 at most."""
    quality = F.create_map(*(F.lit(x) for kv in vocab.SOURCE_QUALITY.items() for x in kv))
    boost = F.aggregate(sources, F.lit(0.0), lambda a, d: a + F.coalesce(F.try_element_at(quality, d), F.lit(0.0))) / 10
    return F.least(F.lit(1.0), F.least(F.lit(1.0), 0.5 + F.size(sources) * 0.15) + boost)


def source_reliability(total: Column, confirmed: Column, contradicted: Column) -> Column:
    share = (confirmed - contradicted * 2) / F.when(total > 0, total) + 0.5
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)), F.lit(0.5))


def cooccurrence(sessions: DataFrame) -> DataFrame:
    """a < b, n: how many sessions (session, id) have both."""
    one = sessions.select("session", "id").distinct()
    a, b = one.select("session", F.col("id").alias("a")), one.select("session", F.col("id").alias("b"))
    return a.join(b, "session").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def missing_edges(pairs: DataFrame, e: DataFrame, least: int = 5) -> DataFrame:
    """Pairs that occur together so often and have no edge either way."""
    ends = e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return pairs.filter(F.col("n") >= least).join(ends, ["a", "b"], "left_anti")


def event_timeline(v: DataFrame, e: DataFrame, most: int = 5) -> DataFrame:
    """id, date, actors of event vertices; date from the attributes date, first_seen or ingested_at."""
    a = F.col("attributes")
    events = v.filter(F.lower("group") == "event").select("id", F.coalesce(a["date"], a["first_seen"], a["ingested_at"]).alias("date"), F.coalesce(a["type"], F.lit("unknown")).alias("type"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"))
    ends = e.select(F.col("src").alias("id"), F.col("dst").alias("actor")).unionByName(e.select(F.col("dst").alias("id"), F.col("src").alias("actor")))
    w = Window.partitionBy("id").orderBy("actor")
    few = ends.distinct().join(events.select("id"), "id", "left_semi").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most)
    actors = few.groupBy("id").agg(F.array_sort(F.collect_list("actor")).alias("actors"))
    return events.join(actors, "id", "left").orderBy(F.coalesce("date", F.lit("")), "id")


def source_entities(evidence: DataFrame) -> DataFrame:
    """source, id: distinct pairs from evidence (id, url); a url without a host counts as unknown."""
    host = F.coalesce(F.nullif(F.regexp_extract("url", "://([^/?#]+)", 1), F.lit("")), F.lit("unknown"))
    return evidence.select(host.alias("source"), "id").distinct()
