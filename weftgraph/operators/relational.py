"""Scans, filters, one-hop joins and degrees. Results have a total order only where a limit needs one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph import predicates
from weftgraph.graph import Graph
from weftgraph.vocab import RESULT_CAP


def shown_group(group: Column | None = None) -> Column:
    return F.coalesce(F.col("group") if group is None else group, F.lit("unknown"))


def shown_confidence() -> Column:
    return F.coalesce(F.col("confidence"), F.lit(1.0))


def named(v: DataFrame, name: str) -> DataFrame:
    """The vertices whose id is name without regard to case, first in order of arrival: one row at most."""
    return v.filter(F.lower("id") == name.lower()).orderBy(F.col("id") != name, F.col("seq").asc_nulls_last(), "id").limit(1)


def find_nodes(g: Graph, group: str, literal: bool = False) -> DataFrame:
    """Vertices of a group, in the singular or plural. literal: only trailing `s` are taken off, so `countries` finds none."""
    if literal:
        match = F.regexp_replace(F.lower(F.coalesce("group", F.lit(""))), "s+$", "") == group.lower().rstrip("s")
    else:
        match = predicates.singular(F.coalesce("group", F.lit(""))) == predicates.singular(F.lit(group))
    return g.v.filter(match).select("id", shown_group().alias("grp"), shown_confidence().alias("confidence"), "seq")


def find_nodes_that(g: Graph, group: str, verb: str, target: str) -> DataFrame:
    """Vertices of a group with an edge to target whose label contains verb."""
    hits = g.e.filter(F.contains(F.lower("label"), F.lit(verb.lower())) & (F.lower("dst") == target.lower())).select(F.col("src").alias("id"))
    return find_nodes(g, group).join(hits, "id", "left_semi")


def count_group(g: Graph, group: str) -> DataFrame:
    every = group.lower() in ("all", "node", "nodes", "entity", "entities", "total")
    return (g.v if every else find_nodes(g, group)).agg(F.lit(group.lower()).alias("grp"), F.count(F.lit(1)).alias("n"))


def confidence_filter(g: Graph, op: str, bound: float) -> DataFrame:
    return g.v.filter(predicates.compare(shown_confidence(), op, F.lit(float(bound)))).select("id", shown_confidence().alias("confidence"), shown_group().alias("grp"), "seq")


def degree(g: Graph) -> DataFrame:
    """id, degree of every vertex: edges out and in, a self-loop counts twice."""
    ends = g.e.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return g.v.select("id", shown_group().alias("grp"), "seq").join(ends, "id", "left").select("id", "grp", F.coalesce("n", F.lit(0)).alias("degree"), "seq")


def degree_filter(g: Graph, op: str, bound: int) -> DataFrame:
    return degree(g).filter(predicates.compare(F.col("degree"), op, F.lit(int(bound))))


def hubs(g: Graph, least: int = 3) -> DataFrame:
    return degree_filter(g, ">=", least)


def top_degree(g: Graph, k: int) -> DataFrame:
    return degree(g).orderBy(F.desc("degree"), F.col("seq").asc_nulls_last(), "id").limit(max(1, k))


def isolated(g: Graph) -> DataFrame:
    ends = g.e.select(F.explode(F.array("src", "dst")).alias("id"))
    return g.v.join(ends, "id", "left_anti").select("id", shown_group().alias("grp"), "seq")


def _edges(e: DataFrame) -> DataFrame:
    return e.select("src", "dst", F.coalesce("label", F.lit("")).alias("label"), shown_confidence().alias("confidence"), "seq")


def edges_with_label(g: Graph, text: str) -> DataFrame:
    return _edges(g.e.filter(F.contains(F.lower(F.coalesce("label", F.lit(""))), F.lit(text.lower()))))


def successors(g: Graph, node: str) -> DataFrame:
    return _edges(g.e.filter(F.col("src") == node))


def predecessors(g: Graph, node: str) -> DataFrame:
    return _edges(g.e.filter(F.col("dst") == node))


def edges_between(g: Graph, a: str, b: str) -> DataFrame:
    return _edges(g.e.filter(((F.col("src") == a) & (F.col("dst") == b)) | ((F.col("src") == b) & (F.col("dst") == a))))


def neighbors(g: Graph, node: str) -> DataFrame:
    """id, direction (out, in or both), grp of the vertices next to node."""
    out = g.e.filter(F.col("src") == node).select(F.col("dst").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"), "seq")
    into = g.e.filter(F.col("dst") == node).select(F.col("src").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"), "seq")
    both = out.unionByName(into).groupBy("id").agg(F.max("o").alias("o"), F.max("i").alias("i"), F.min("seq").alias("seq"))
    direction = F.when((F.col("o") == 1) & (F.col("i") == 1), "both").when(F.col("o") == 1, "out").otherwise("in")
    return both.join(g.v.select("id", "group"), "id", "left").select("id", direction.alias("direction"), shown_group().alias("grp"), "seq")


def capped(df: DataFrame, order: list | None = None, cap: int = RESULT_CAP) -> DataFrame:
    """The first rows in order of arrival (or the given order), at most cap."""
    keys = order if order is not None else [F.col("seq").asc_nulls_last(), *(c for c in ("id", "src", "dst") if c in df.columns)]
    return df.orderBy(*keys).limit(cap)


def group_counts(g: Graph) -> DataFrame:
    return g.v.groupBy(shown_group().alias("grp")).agg(F.count(F.lit(1)).alias("n"))


def composition(g: Graph) -> DataFrame:
    """Group names in title case with their counts, as a report tables them."""
    return group_counts(g).select(F.initcap("grp").alias("entity_type"), "n")


def group_confidence_rollup(g: Graph) -> DataFrame:
    """Counts by group and confidence in tenths, with subtotals by group and in all."""
    return g.v.select(shown_group().alias("grp"), F.floor(shown_confidence() * 10).alias("tenth")).rollup("grp", "tenth").agg(F.count(F.lit(1)).alias("n"))


def edge_sample(g: Graph, edges: int = 25, hubs_: int = 10) -> DataFrame:
    """Lines `a -[label]-> b`: edges at the top hubs first, then others, each line once."""
    top = F.broadcast(top_degree(g, hubs_).select(F.col("id").alias("hub")))  # at most hubs_ rows
    line = F.concat(F.col("src"), F.lit(" -["), F.coalesce("label", F.lit("")), F.lit("]-> "), F.col("dst"))
    at_hub = g.e.join(top, (F.col("src") == F.col("hub")) | (F.col("dst") == F.col("hub")), "left")
    lines = at_hub.groupBy("src", "dst", line.alias("line")).agg(F.max(F.col("hub").isNotNull()).alias("hub"), F.min("seq").alias("seq"))
    return lines.orderBy(F.desc("hub"), F.col("seq").asc_nulls_last(), "src", "dst").limit(edges).select("line", "hub")
