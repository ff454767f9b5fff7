"""Graphs in node-link JSON: a node list and a link list (named links or edges) in one object."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from weftgraph.graph import Graph

_ENTRY = "struct<source: string, target: string, label: string, confidence: double, weight: double>"
SCHEMA = f"nodes array<struct<id: string, group: string, confidence: double, title: string, attributes: map<string,string>>>, links array<{_ENTRY}>, edges array<{_ENTRY}>, _corrupt_record string"


def _literal(text: str | None) -> dict[str, str] | None:
    if not text:
        return None
    try:
        value = ast.literal_eval(text)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return None
    return {str(k): str(v) for k, v in value.items()} if isinstance(value, dict) else None


@F.pandas_udf(MapType(StringType(), StringType()))
def literal_map(text: pd.Series) -> pd.Series:
    """A Python dict literal as a map; null where it is none."""
    return text.map(_literal)


def title_map(title):
    """The attributes that a title holds: JSON with either quote, else a Python literal; only titles that are no JSON are sent to Python."""
    told = F.from_json(title, "map<string,string>")
    return F.coalesce(told, literal_map(F.when(told.isNull(), title)))


def load(spark: SparkSession, path: str) -> Graph:
    """A graph from a file (or files); a corrupt one adds nothing. Order of arrival is the position in the lists."""
    raw = spark.read.schema(SCHEMA).json(path, multiLine=True)
    v = raw.select(F.posexplode("nodes").alias("seq", "n")).select("n.*", F.col("seq").cast("bigint").alias("seq"))
    v = v.withColumn("attributes", F.coalesce("attributes", title_map(F.col("title"))))
    e = raw.select(F.posexplode(F.coalesce("links", "edges")).alias("seq", "e"))
    e = e.select(F.col("e.source").alias("src"), F.col("e.target").alias("dst"), "e.label", "e.confidence", "e.weight", F.col("seq").cast("bigint").alias("seq"))
    return Graph.of(v, e)


#: Lines around the nodes and the links.
_HEAD, _BETWEEN, _FOOT = '{"directed": true, "multigraph": false, "graph": {}, "nodes": [', '], "links": [', "]}"
_LINE = "struct<id: string, group: string, confidence: double, title: string, attributes: map<string,string>, seq: bigint, source: string, target: string, label: string, weight: double>"


def document_lines(g: Graph) -> DataFrame:
    """place, key, value: the lines of one JSON document, in the order of place and key; a node or a link to a line."""
    node = F.to_json(F.struct("id", "group", "confidence", "title", "attributes", "seq"))
    link = F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "label", "confidence", "weight", "seq"))

    def part(df: DataFrame, key, value, place: int) -> DataFrame:
        first = F.broadcast(df.agg(F.min(key).alias("first")))  # the first one has no comma before it
        rows = df.select(key.alias("key"), value.alias("value")).join(first)
        own = F.col("key") == F.col("first")
        return rows.select(F.when(own, place).otherwise(place + 1).alias("place"), "key", F.when(own, F.col("value")).otherwise(F.concat(F.lit(","), "value")).alias("value"))

    ends = g.spark.createDataFrame([(0, "", _HEAD), (3, "", _BETWEEN), (6, "", _FOOT)], "place int, key string, value string")
    pair = F.concat(F.length("src").cast("string"), F.lit(":"), "src", "dst")
    return ends.unionByName(part(g.v, F.col("id"), node, 1)).unionByName(part(g.e, pair, link, 4))


def save(g: Graph, path: str) -> None:
    """Files under path that, one after the other by their names, are one JSON document; each task writes its range of lines."""
    rows = document_lines(g).repartitionByRange("place", "key").sortWithinPartitions("place", "key")
    rows.select("value").write.mode("overwrite").text(path)


def load_saved(spark: SparkSession, path: str) -> Graph:
    """A graph that save has written, line by line."""
    rows = spark.read.text(path).filter(F.startswith("value", F.lit("{\"")) | F.startswith("value", F.lit(",{\""))).filter(F.col("value") != _HEAD)
    rows = rows.select(F.from_json(F.regexp_replace("value", "^,", ""), _LINE).alias("x")).select("x.*")
    v = rows.filter("source is null and id is not null")
    e = rows.filter("source is not null").select(F.col("source").alias("src"), F.col("target").alias("dst"), "label", "confidence", "weight", "seq")
    return Graph.of(v, e)


def dumps(g: Graph) -> str:
    """The document as text, for graphs that a reader can hold."""
    rows = document_lines(g).orderBy("place", "key").select("value").toLocalIterator()
    return json.dumps(json.loads("".join(r.value for r in rows)), indent=2)
