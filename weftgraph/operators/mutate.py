"""Changes of a graph: resolution of names, upserts, merges, enrichment, differences. Each returns new frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph import vocab
from weftgraph.graph import EDGES, VERTICES, Graph, conform
from weftgraph.operators.matching import alike, leaders, one_off
from weftgraph.stage import sorted_side, stage

def resolve(names: DataFrame, v: DataFrame, threshold: float = vocab.FUZZY_THRESHOLD, aliases: DataFrame | None = None) -> DataFrame:
    """name, id for each distinct name: the vertex it means, or null.

    An alias (alias, id) counts first, then an equal name without regard to case, then the most similar vertex of at least
    the threshold, first in order of arrival. Vertices whose names differ by one character more or less are joined on it, and no
    other is as similar. For names without one, every pair is bounded by the characters that both names have; only those
    whose bound reaches the best ratio so far are matched.
    """
    names = names.select("name").filter("name is not null").distinct()
    ids = v.select("id", "seq")
    exact = names.join(sorted_side(ids.withColumn("low", F.lower("id"))), F.lower("name") == F.col("low"))
    best = F.min_by("id", F.struct(F.col("id") != F.col("name"), F.coalesce("seq", F.lit(2**62)), "id"))
    found = exact.groupBy("name").agg(best.alias("id"))
    if aliases is not None:
        told = names.join(sorted_side(aliases.select(F.lower("alias").alias("low"), F.col("id").alias("told"))), F.lower("name") == F.col("low")).groupBy("name").agg(F.min("told").alias("id"))
        found = told.unionByName(found.join(sorted_side(told), "name", "left_anti"))
    found = stage(found, "resolve-exact")
    left = stage(names.join(sorted_side(found), "name", "left_anti"), "resolve-left")
    near = one_off(left, ids, threshold)
    left = stage(left.join(sorted_side(near.select("name")), "name", "left_anti"), "resolve-far")
    every = near if left.isEmpty() else near.unionByName(alike(left, ids.select("id").distinct(), threshold, best=True))
    scored = every.join(sorted_side(ids), "id")
    fuzzy = scored.groupBy("name").agg(F.min_by("id", F.struct(-F.col("score"), F.coalesce("seq", F.lit(2**62)), "id")).alias("id"))
    return names.join(sorted_side(found.unionByName(fuzzy)), "name", "left")


def similar_pairs(v: DataFrame, threshold: float = 0.8) -> DataFrame:
    """a < b, score: vertices of one graph whose names are alike."""
    ids = v.select("id").filter("id is not null").distinct()
    ranked = ids.withColumn("rank", F.col("id"))
    found = alike(ranked.withColumnRenamed("id", "name"), ranked, threshold, ranked=True).filter(F.col("score") > threshold)
    return found.select(F.col("id").alias("a"), F.col("name").alias("b"), "score")


@dataclass
class Change:
    graph: Graph
    nodes_added: DataFrame
    edges_added: DataFrame


def _entities(x: DataFrame) -> DataFrame:
    return x.filter(F.lower("class") != vocab.RELATIONSHIP).select(F.col("text").alias("name"), F.lower("class").alias("kind"), "attributes", "confidence", "pos")


def _relations(x: DataFrame) -> DataFrame:
    told = x.filter(F.lower("class") == vocab.RELATIONSHIP)
    return told.select(F.col("attributes")["source"].alias("a"), F.col("attributes")["target"].alias("b"), F.col("text").alias("label"), "confidence", "pos")


def named(v: DataFrame, extractions: DataFrame, threshold: float = vocab.FUZZY_THRESHOLD, aliases: DataFrame | None = None) -> DataFrame:
    """name, id of all names of extractions: resolved to the vertices v (id, seq), then to each other in order."""
    relations = _relations(extractions)
    every = _entities(extractions).select("name", "pos").unionByName(relations.select(F.col("a").alias("name"), "pos")).unionByName(relations.select(F.col("b").alias("name"), "pos"))
    mentions = stage(every.groupBy("name").agg(F.min("pos").alias("pos")), "upsert-names")
    known = stage(resolve(mentions, v, threshold, aliases), "upsert-known")
    fresh = mentions.join(known.filter("id is null").select("name"), "name", "left_semi")
    return known.filter("id is not null").unionByName(leaders(fresh, threshold))


def edges_of(extractions: DataFrame, names: DataFrame) -> DataFrame:
    """src, dst, label, confidence, weight, seq: for each ordered pair of vertices the last relationship."""
    a, b = names.select(F.col("name").alias("a"), F.col("id").alias("src")), names.select(F.col("name").alias("b"), F.col("id").alias("dst"))
    linked = _relations(extractions).join(a, "a").join(b, "b")
    last = linked.groupBy("src", "dst").agg(F.max_by(F.struct("label", "confidence", "pos"), "pos").alias("x"))
    return last.select("src", "dst", "x.label", "x.confidence", F.lit(None).cast("double").alias("weight"), F.col("x.pos").alias("seq"))


def applied(g: Graph, extractions: DataFrame, names: DataFrame) -> Change:
    """g with the extractions whose names mean the given ids. Of the graph only vertices and pairs that are named need be in g."""
    called = _entities(extractions).join(names, "name").withColumn("title", F.to_json("attributes"))
    rank = F.struct("confidence", -F.col("pos"))
    told = called.groupBy("id").agg(F.max_by("title", rank).alias("new_title"), F.max("confidence").alias("new_confidence"), F.min_by("kind", "pos").alias("new_group"), F.max_by("attributes", rank).alias("new_attributes"), F.min("pos").alias("pos"))
    better = F.col("new_confidence") > F.coalesce("confidence", F.lit(0.0))
    grouped = F.when(F.coalesce("group", F.lit("unknown")) == "unknown", F.coalesce("new_group", "group")).otherwise(F.col("group"))
    old = g.v.join(told.drop("pos"), "id", "left").select(
        "id", grouped.alias("group"), F.when(better, F.col("new_confidence")).otherwise(F.col("confidence")).alias("confidence"), F.when(better, F.col("new_title")).otherwise(F.col("title")).alias("title"),
        F.when(better, F.col("new_attributes")).otherwise(F.col("attributes")).alias("attributes"), "seq",
    )
    added = told.join(g.v.select("id"), "id", "left_anti").select("id", F.col("new_group").alias("group"), F.col("new_confidence").alias("confidence"), F.col("new_title").alias("title"), F.col("new_attributes").alias("attributes"), F.col("pos").alias("seq"))
    last = stage(edges_of(extractions, names), "upsert-edges")
    ends = last.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    stubs = ends.join(g.v.select("id"), "id", "left_anti").join(added.select("id"), "id", "left_anti").withColumn("group", F.lit("unknown"))
    v = old.unionByName(added).unionByName(conform(stubs, VERTICES))
    e = g.e.join(last.select("src", "dst"), ["src", "dst"], "left_anti").unionByName(conform(last, EDGES))
    edges_added = last.join(g.e.select("src", "dst"), ["src", "dst"], "left_anti")
    return Change(Graph(v, conform(e, EDGES)), added.select("id"), edges_added.select("src", "dst"))


def upsert(g: Graph, extractions: DataFrame, threshold: float = vocab.FUZZY_THRESHOLD, aliases: DataFrame | None = None) -> Change:
    """Adds entities and relationships (class, text, attributes, confidence, pos).

    Names are resolved to vertices, then to each other in order. Of an entity's mentions the most confident gives title and
    confidence, if it is more confident than the vertex was; a group replaces `unknown` only. A relationship's ends that
    no entity names become vertices of the group unknown, which do not count as added. Of edges with the same ends the
    last wins, over older ones too.
    """
    return applied(g, extractions, stage(named(g.v, extractions, threshold, aliases), "upsert-resolved"))


def merge(g: Graph, source: str, target: str) -> Graph:
    """Source's edges go to target and source goes; edges between the two go. A missing target renames source.

    Weights (1 where missing) of edges that fall together add up; target's label and confidence win over source's.
    Target's attributes win; source's fill in.
    """
    moved = F.when(F.col("id") == source, target).otherwise(F.col("id"))
    first = lambda c: F.min_by(c, F.struct(F.col("own"), F.coalesce("seq", F.lit(2**62)))).alias(c)
    v = g.v.withColumn("own", (F.col("id") == source).cast("int")).withColumn("id", moved)
    filled = lambda c: F.coalesce(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("own"))), F.lit(None)).alias(c)
    pair = v.filter(F.col("id") == target)
    merged = pair.groupBy("id").agg(filled("group"), filled("confidence"), filled("title"), F.max(F.when(F.col("own") == 0, F.to_json("attributes"))).alias("t"), F.max(F.when(F.col("own") == 1, F.to_json("attributes"))).alias("s"), F.min("seq").alias("seq"))
    kind = "map<string,string>"
    target_map, source_map = (F.coalesce(F.from_json(c, kind), F.create_map().cast(kind)) for c in ("t", "s"))
    fills = F.map_filter(source_map, lambda k, _: ~F.map_contains_key(target_map, k))
    attributes = F.when(F.col("t").isNotNull() | F.col("s").isNotNull(), F.map_concat(target_map, fills))
    merged = merged.withColumn("attributes", attributes)
    vertices = v.filter(F.col("id") != target).select(g.v.columns).unionByName(conform(merged, VERTICES))
    ends = {c: F.when(F.col(c) == source, target).otherwise(F.col(c)) for c in ("src", "dst")}
    inner = (F.col("src").isin(source, target)) & (F.col("dst").isin(source, target))
    e = g.e.filter(~inner).withColumn("own", ((F.col("src") == source) | (F.col("dst") == source)).cast("int"))
    e = e.withColumns(ends).groupBy("src", "dst").agg(first("label"), first("confidence"), F.when((F.count(F.lit(1)) > 1) | F.max(F.col("weight").isNotNull()), F.sum(F.coalesce("weight", F.lit(1.0)))).alias("weight"), F.min("seq").alias("seq"))
    return Graph(vertices, conform(e, EDGES))


def enrich(g: Graph, facts: DataFrame) -> Graph:
    """Adds attributes (id, attributes) to vertices; later ones win."""
    kind = "map<string,string>"
    old, new = (F.coalesce(F.col(c), F.create_map().cast(kind)) for c in ("attributes", "more"))
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    v = g.v.join(facts.select("id", F.col("attributes").alias("more")), "id", "left")
    return Graph(conform(v.withColumn("attributes", F.when(F.col("more").isNull(), F.col("attributes")).otherwise(F.map_concat(kept, new))), VERTICES), g.e)


def apply_changes(g: Graph, add: DataFrame, remove: DataFrame) -> Graph:
    """A scenario: edges added (src, dst, label, confidence) and removed (src, dst), on a derived graph."""
    e = g.e.join(remove.select("src", "dst"), ["src", "dst"], "left_anti").join(add.select("src", "dst"), ["src", "dst"], "left_anti")
    ends = add.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(g.v.select("id"), "id", "left_anti")
    return Graph(g.v.unionByName(conform(ends.withColumn("group", F.lit("unknown")), VERTICES)), conform(e, EDGES).unionByName(conform(add, EDGES)))


def clear(g: Graph) -> Graph:
    return Graph.empty(g.spark)


def diff(a: Graph, b: Graph) -> DataFrame:
    """item (node or edge), key, status (added, removed or changed) from a to b; a change is one of group or label."""
    nodes = lambda g: g.v.select(F.lit("node").alias("item"), F.col("id").alias("key"), F.coalesce("group", F.lit("unknown")).alias("value"))
    edges = lambda g: g.e.select(F.lit("edge").alias("item"), F.concat_ws(">", "src", "dst").alias("key"), F.coalesce("label", F.lit("")).alias("value"))
    one, two = nodes(a).unionByName(edges(a)), nodes(b).unionByName(edges(b)).withColumnRenamed("value", "new_value")
    both = one.join(two, ["item", "key"], "full_outer")
    status = F.when(F.col("value").isNull(), "added").when(F.col("new_value").isNull(), "removed").when(F.col("value") != F.col("new_value"), "changed")
    return both.select("item", "key", status.alias("status")).filter("status is not null")


def recurrence(graphs: dict[str, Graph], least: int = 2) -> DataFrame:
    """id, workspaces, n: vertices in at least so many graphs."""
    every = None
    for name, g in graphs.items():
        one = g.v.select("id", F.lit(name).alias("workspace"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("id").agg(F.concat_ws(",", F.array_sort(F.collect_set("workspace"))).alias("workspaces"), F.count_distinct("workspace").alias("n")).filter(F.col("n") >= least)


def keep_newest(df: DataFrame, time: str, most: int, tie: str) -> DataFrame:
    """The newest `most` rows, newest first."""
    return df.orderBy(F.desc(time), F.desc(tie)).limit(most)


def keep_newest_of_each(df: DataFrame, key: str, time: str, most: int, tie: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(time), F.desc(tie))
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most)


