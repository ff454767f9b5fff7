"""Exports: edge CSV, GraphML, Markdown briefs, and snapshots with retention."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.graph import EDGES, VERTICES, Graph
from weftgraph.operators.relational import group_counts, shown_confidence, shown_group
from weftgraph.sources import pdf
from weftgraph.stage import stage

MAX_SNAPSHOTS, DEBOUNCE_SECONDS = 50, 30
STAMP = "%Y-%m-%dT%H%M%SZ"


def edge_csv(g: Graph) -> DataFrame:
    """source, target, label, confidence as text; blank where absent."""
    return g.e.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.coalesce("label", F.lit("")).alias("label"), F.coalesce(F.col("confidence").cast("string"), F.lit("")).alias("confidence"))


def write_csv(g: Graph, path: str) -> None:
    edge_csv(g).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def _xml(c):
    c = F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(c, F.lit('"'), F.lit("&quot;"))


_KEYS = (("n_group", "node", "string"), ("n_confidence", "node", "double"), ("n_title", "node", "string"), ("n_attributes", "node", "string"), ("e_label", "edge", "string"), ("e_confidence", "edge", "double"), ("e_weight", "edge", "double"))
_KEY_TAGS = "".join(f'<key id="{k}" for="{f}" attr.name="{k.split("_")[1]}" attr.type="{t}"/>' for k, f, t in _KEYS)
GRAPHML_HEAD = f'<?xml version="1.0" encoding="utf-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">{_KEY_TAGS}<graph edgedefault="directed">'


def graphml_rows(g: Graph) -> DataFrame:
    """part (0 head, 1 nodes, 2 edges, 3 foot) and value: lines of GraphML. Attributes are written as JSON text."""

    def data(key: str, c):
        return F.when(c.isNotNull(), F.concat(F.lit(f'<data key="{key}">'), _xml(c.cast("string")), F.lit("</data>"))).otherwise("")

    ends = g.spark.createDataFrame([(0, GRAPHML_HEAD), (3, "</graph></graphml>")], "part int, value string")
    nodes = g.v.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('">'), data("n_group", F.col("group")), data("n_confidence", F.col("confidence")), data("n_title", F.col("title")), data("n_attributes", F.to_json("attributes")), F.lit("</node>")).alias("value"))
    edges = g.e.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), _xml(F.col("src")), F.lit('" target="'), _xml(F.col("dst")), F.lit('">'), data("e_label", F.col("label")), data("e_confidence", F.col("confidence")), data("e_weight", F.col("weight")), F.lit("</edge>")).alias("value"))
    return ends.unionByName(nodes).unionByName(edges)


def write_graphml(g: Graph, path: str) -> None:
    """Files under path that, one after the other by their names, are one GraphML document; each task writes its range of lines."""
    graphml_rows(g).repartitionByRange("part", "value").sortWithinPartitions("part", "value").select("value").write.mode("overwrite").text(path)


def dossiers(g: Graph, entities: DataFrame, out: int = 10, into: int = 10) -> DataFrame:
    """id, grp, confidence, outgoing, incoming: lists of lines for each entity (id), the first by order of arrival."""
    label = F.coalesce("label", F.lit("relates to"))

    def side(mine: str, other: str, line, most: int, name: str) -> DataFrame:
        w = Window.partitionBy(mine).orderBy(F.col("seq").asc_nulls_last(), other)
        rows = g.e.join(entities.select(F.col("id").alias(mine)), mine, "left_semi").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most)
        return rows.groupBy(F.col(mine).alias("id")).agg(F.array_sort(F.collect_list(F.struct("rn", line.alias("line")))).getField("line").alias(name))

    outgoing = side("src", "dst", F.concat(F.lit("- "), "src", F.lit(" → *"), label, F.lit("* → **"), "dst", F.lit("**")), out, "outgoing")
    incoming = side("dst", "src", F.concat(F.lit("- **"), "src", F.lit("** → *"), label, F.lit("* → "), "dst"), into, "incoming")
    chosen = g.v.join(entities.select("id"), "id", "left_semi")
    return chosen.select("id", shown_group().alias("grp"), shown_confidence().alias("confidence"), "attributes").join(outgoing, "id", "left").join(incoming, "id", "left")


def markdown_brief(g: Graph, entities: list[str], now: datetime, summary: str = "", title: str = "Knowledge graph brief") -> str:
    """A report on a few entities: a header, a summary if given, a dossier each, and the graph's composition."""
    spark, stamp = g.spark, f"{now:%Y-%m-%d %H:%M} UTC"
    lines = [f"# {title}", f"**Generated:** {stamp}", f"**Graph:** {g.v.count()} entities, {g.e.count()} relationships", ""]
    if summary:
        lines += ["## Summary", "", summary, ""]
    if entities:
        lines += ["## Entities", ""]
        rows = {r.id: r for r in dossiers(g, spark.createDataFrame([(x,) for x in entities], "id string")).collect()}
        for r in (rows[x] for x in entities if x in rows):
            lines += [f"### {r.id}", f"**Type:** {r.grp.upper()}, **confidence:** {r.confidence:.0%}", ""]
            for name, part in (("Outgoing", r.outgoing), ("Incoming", r.incoming)):
                if part:
                    lines += [f"**{name}:**", "", *part, ""]
            if r.attributes:
                lines += ["**Attributes:**", "", *(f"- **{k}:** {v}" for k, v in list(r.attributes.items())[:8]), ""]
    lines += ["## Composition", "", "| Entity type | Count |", "|---|---|"]
    lines += [f"| {r.grp.title()} | {r.n} |" for r in group_counts(g).orderBy(F.desc("n"), "grp").collect()]
    return "\n".join([*lines, ""])


#: Briefs that a task writes.
_FILES = 500


def pdf_briefs(g: Graph, entities: DataFrame, title: str = "Knowledge graph brief") -> DataFrame:
    """id, pdf: a brief on each entity (id), eight relationships each way at most, written by the task that has it."""
    rows = dossiers(g, entities, 8, 8).select("id", "grp", "confidence", *(F.transform(c, lambda x: F.replace(F.substr(x, F.lit(3)), F.lit("*"), F.lit(""))).alias(c) for c in ("outgoing", "incoming")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            out = []
            for id_, grp, confidence, outgoing, incoming in zip(*(x[c] for c in ("id", "grp", "confidence", "outgoing", "incoming"))):
                lines = [f"# {title}", f"## {id_}", f"Type: {grp.upper()}, confidence: {confidence:.0%}"]
                for name, part in (("Outgoing", outgoing), ("Incoming", incoming)):
                    if part is not None:
                        lines += [f"{name}:", *part]
                out.append((id_, pdf.write(lines, f"{title}: {id_}")))
            yield pd.DataFrame(out, columns=["id", "pdf"])

    rows = stage(rows, "brief-lines")  # little to read for much to do: dealt by their number, not by their bytes
    return rows.repartition(max(1, -(-rows.count() // _FILES)), "id").mapInPandas(run, "id string, pdf binary")


def pdf_text(files: DataFrame) -> DataFrame:
    """id, text of files (id, pdf)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            yield pd.DataFrame({"id": x["id"], "text": [pdf.read(bytes(p)) for p in x["pdf"]]})

    return files.select("id", "pdf").mapInPandas(run, "id string, text string")


def note_vault(g: Graph) -> DataFrame:
    """id, note: a note for each vertex with wiki links to its successors."""
    links = g.e.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.concat(F.lit("- "), F.coalesce("label", F.lit("relates to")), F.lit(" [["), "dst", F.lit("]]")))).alias("links"))
    note = F.concat_ws("\n", F.concat(F.lit("# "), "id"), F.concat(F.lit("type: "), shown_group()), F.col("links"))
    return g.v.join(links, "id", "left").select("id", note.alias("note"))


def save_snapshot(g: Graph, root: str, now: datetime, force: bool = False) -> str | None:
    """Writes vertices and edges under root/snapshot_ts=...; None if the last snapshot is younger than the debounce."""
    past = snapshots(g.spark, root)
    if past and not force and (now - datetime.strptime(past[0], STAMP)).total_seconds() < DEBOUNCE_SECONDS:
        return None
    stamp = now.strftime(STAMP)
    g.v.write.mode("overwrite").parquet(f"{root}/vertices/snapshot_ts={stamp}")
    g.e.write.mode("overwrite").parquet(f"{root}/edges/snapshot_ts={stamp}")
    for old in snapshots(g.spark, root)[MAX_SNAPSHOTS:]:
        for part in ("vertices", "edges"):
            _fs(g.spark, root).delete(_path(g.spark, f"{root}/{part}/snapshot_ts={old}"), True)
    return stamp


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def snapshots(spark: SparkSession, root: str, newest_first: bool = True) -> list[str]:
    """The stamps of the snapshots under root; names come from the store, by Hadoop's file system."""
    fs, at = _fs(spark, root), _path(spark, f"{root}/edges")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted((n.removeprefix("snapshot_ts=") for n in names if n.startswith("snapshot_ts=")), reverse=newest_first)


def load_snapshot(spark: SparkSession, root: str, stamp: str) -> Graph:
    """One snapshot. A stamp that is not of the written form is refused."""
    datetime.strptime(stamp, STAMP)
    return Graph(spark.read.schema(VERTICES).parquet(f"{root}/vertices/snapshot_ts={stamp}"), spark.read.schema(EDGES).parquet(f"{root}/edges/snapshot_ts={stamp}"))
