"""Edge analytics: totals, tension, conflicts, triangles, hotspots, risk and health.

Ratios and scores are left unrounded where other operators use them, and rounded half up where a result shows them.
Scalars over the whole graph are one-row aggregates, joined as one broadcast row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph import predicates, vocab
from weftgraph.graph import Graph
from weftgraph.operators.relational import degree, shown_confidence, shown_group


def totals(g: Graph) -> DataFrame:
    """n_nodes, n_edges, density (edges / (n (n - 1)), 4 places); zeros for an empty graph."""
    counts = g.v.agg(F.count(F.lit(1)).alias("n_nodes"))
    edges = g.e.agg(F.count(F.lit(1)).alias("n_edges"))
    n = F.col("n_nodes")
    density = F.when(n > 1, F.round(F.col("n_edges") / (n * (n - 1)), 4)).otherwise(0.0)
    return counts.join(F.broadcast(edges)).select("n_nodes", "n_edges", density.alias("density"))


def degree_centrality(g: Graph) -> DataFrame:
    """id, centrality: degree / (n - 1), 1 in a graph of one vertex."""
    n = g.v.agg(F.count(F.lit(1)).alias("n"))
    return degree(g).join(F.broadcast(n)).select("id", F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1)).otherwise(1.0).alias("centrality"), "grp", "seq")


def raw_tension(g: Graph) -> DataFrame:
    """id, raw for every country: hostile edges out and in, military events beside it, raised by the degree."""
    groups = g.v.select(F.col("id").alias("other"), (F.coalesce(F.lower("group"), F.lit("")) == "event").alias("event"))
    score = predicates.edge_score(F.col("label"))
    out = g.e.select(F.col("src").alias("id"), F.col("dst").alias("other"), (score * 1.2).alias("part"))
    into = g.e.select(F.col("dst").alias("id"), F.col("src").alias("other"), (score * 0.9).alias("part"))
    sides = out.unionByName(into).join(groups, "other", "left")
    bonus = F.when(F.coalesce("event", F.lit(False)) & predicates.military(F.col("other")), 7.0).otherwise(0.0)
    # an end for each row, so its count is the degree
    sums = sides.groupBy("id").agg(F.sum(F.col("part") + bonus).alias("sum"), F.count(F.lit(1)).alias("degree"))
    chosen = g.v.filter(predicates.country(F.col("id"), F.col("group"))).select("id", "group")
    raised = F.coalesce(F.col("sum"), F.lit(0.0)) * (1 + 0.04 * F.least(F.coalesce("degree", F.lit(0)), F.lit(20)))
    return chosen.join(sums, "id", "left").select("id", "group", raised.alias("raw"), F.coalesce("degree", F.lit(0)).alias("degree"))


def country_tension(g: Graph, thresholds: DataFrame | None = None) -> DataFrame:
    """id, score (0 to 100), threshold, alert. thresholds: id, threshold; others have 75."""
    raw = raw_tension(g)
    most = F.broadcast(raw.agg(F.greatest(F.max("raw"), F.lit(1.0)).alias("most")))
    scored = raw.join(most).select("id", "group", "degree", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("raw") / F.col("most") * 100)).alias("score"))
    if thresholds is not None:
        scored = scored.join(thresholds.select("id", "threshold"), "id", "left")
        scored = scored.withColumn("threshold", F.coalesce("threshold", F.lit(vocab.ALERT_THRESHOLD)))
    else:
        scored = scored.withColumn("threshold", F.lit(vocab.ALERT_THRESHOLD))
    return scored.withColumn("alert", F.col("score") >= F.col("threshold"))


def gazetteer(g: Graph) -> DataFrame:
    return g.spark.createDataFrame(list(vocab.GAZETTEER), "id string, lat double, lon double")


def connections(g: Graph, ids: DataFrame, most: int = 5) -> DataFrame:
    """id, connections: `label dst` of edges out, then `src label` of edges in, the first `most` in order."""
    label = F.coalesce("label", F.lit("connects to"))
    out = g.e.select(F.col("src").alias("id"), F.lit(0).alias("side"), F.concat_ws(" ", label, "dst").alias("text"), "seq", F.col("dst").alias("other"))
    # a self-loop is an edge out on both sides
    into = g.e.select(F.col("dst").alias("id"), F.lit(1).alias("side"), F.when(F.col("src") == F.col("dst"), F.concat_ws(" ", label, "dst")).otherwise(F.concat_ws(" ", "src", label)).alias("text"), "seq", F.col("src").alias("other"))
    w = Window.partitionBy("id").orderBy("side", F.col("seq").asc_nulls_last(), "other")
    rows = out.unionByName(into).join(ids.select("id"), "id", "left_semi").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most)
    return rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rn", "text"))).getField("text").alias("connections"))


def geo_markers(g: Graph, places: DataFrame | None = None, thresholds: DataFrame | None = None) -> DataFrame:
    """A marker for each country that places (id, lat, lon; the gazetteer by default) has."""
    places = gazetteer(g) if places is None else places
    marked = country_tension(g, thresholds).join(places, "id")
    texts = connections(g, marked)
    text = F.coalesce(F.concat_ws("; ", "connections"), F.lit(""))
    return marked.join(texts, "id", "left").select(
        "id", "lat", "lon", F.coalesce("group", F.lit("country")).alias("grp"), F.round("score", 1).alias("tension"), predicates.tension_colour(F.col("score")).alias("colour"), "threshold", "alert", text.alias("connections"), "degree"
    )


def _both_ways(g: Graph) -> DataFrame:
    """a <= b, the labels of a to b and of b to a, of pairs with edges both ways (a self-loop is both ways)."""
    one = g.e.filter("src <= dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.coalesce("label", F.lit("")).alias("label_ab"))
    other = g.e.filter("dst <= src").select(F.col("dst").alias("a"), F.col("src").alias("b"), F.coalesce("label", F.lit("")).alias("label_ba"))
    return one.join(other, ["a", "b"])


def conflicts(g: Graph) -> DataFrame:
    """Pairs with a hostile edge one way and a cooperative one the other way; a label that is both is hostile."""
    hostile = lambda c: predicates.hostile(F.col(c))
    coop = lambda c: predicates.cooperative(F.col(c)) & ~hostile(c)
    return _both_ways(g).filter((hostile("label_ab") & coop("label_ba")) | (coop("label_ab") & hostile("label_ba")))


def reciprocal_hostility(g: Graph) -> DataFrame:
    return _both_ways(g).filter(predicates.hostile(F.col("label_ab")) & predicates.hostile(F.col("label_ba")))


def _hostile_edges(g: Graph) -> DataFrame:
    return g.e.filter(predicates.hostile(F.col("label"))).select("src", "dst")


def conflict_triangles(g: Graph) -> DataFrame:
    """a, b, c (sorted): two hostile steps u to v to w, closed by a hostile edge; where u to w exists, it must be that one."""
    h = _hostile_edges(g)
    paths = h.select(F.col("src").alias("u"), F.col("dst").alias("v")).join(h.select(F.col("src").alias("v"), F.col("dst").alias("w")), "v").filter("u <> v and u <> w")
    forth = g.e.select(F.col("src").alias("u"), F.col("dst").alias("w"), predicates.hostile(F.col("label")).alias("forth"))
    back = g.e.select(F.col("dst").alias("u"), F.col("src").alias("w"), predicates.hostile(F.col("label")).alias("back"))
    closed = paths.join(forth, ["u", "w"], "left").join(back, ["u", "w"], "left").filter(F.coalesce("forth", "back", F.lit(False)))
    ids = F.array_sort(F.array("u", "v", "w"))
    return closed.select(*(ids[i].alias(c) for i, c in enumerate("abc"))).filter("a <> b and b <> c").distinct()


def unstable_triangles(g: Graph) -> DataFrame:
    """a < b < c, pairwise connected, with two hostile sides and a cooperative one.

    A side is hostile if an edge of either direction is, else cooperative if one is.
    """
    side = g.e.filter("src <> dst").select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y"), predicates.hostile(F.col("label")).alias("h"), predicates.cooperative(F.col("label")).alias("c"))
    side = side.groupBy("x", "y").agg(F.max("h").alias("h"), F.max("c").alias("c")).select("x", "y", F.when(F.col("h"), 1).when(F.col("c"), 0).alias("kind")).filter("kind is not null")
    ab, bc, ac = (side.select(F.col("x").alias(p), F.col("y").alias(q), F.col("kind").alias(p + q)) for p, q in ("ab", "bc", "ac"))
    return ab.join(bc, "b").join(ac, ["a", "c"]).filter("ab + bc + ac = 2").select("a", "b", "c")


def hostile_ratio(g: Graph) -> DataFrame:
    return g.e.agg(F.coalesce(F.avg(predicates.hostile(F.col("label")).cast("double")), F.lit(0.0)).alias("ratio"))


def global_risk(g: Graph) -> DataFrame:
    """risk (0 to 100), label, ratio, n_reciprocal, n_triangles (at most 5 count)."""
    pairs = reciprocal_hostility(g).agg(F.count(F.lit(1)).alias("n_reciprocal"))
    triangles = conflict_triangles(g).agg(F.least(F.count(F.lit(1)), F.lit(5)).alias("n_triangles"))
    risk = F.least(F.lit(100.0), F.least(F.col("n_reciprocal") * 12.0, F.lit(40.0)) + F.least(F.col("n_triangles") * 8.0, F.lit(24.0)) + F.col("ratio") * 36.0)
    row = hostile_ratio(g).join(F.broadcast(pairs)).join(F.broadcast(triangles)).withColumn("raw", risk)
    return row.select(F.round("raw", 1).alias("risk"), predicates.risk_label(F.col("raw")).alias("label"), F.round("ratio", 3).alias("ratio"), "n_reciprocal", "n_triangles")


def hotspots(g: Graph, between: DataFrame, top: int = 8) -> DataFrame:
    """id, score of the vertices most involved in hostile edges. between: id, betweenness of the whole graph."""
    label = F.col("label")
    weight = F.when(predicates.hostile(label), 3.0).when(predicates.cooperative(label), -1.0).otherwise(0.5)
    ends = g.e.select(F.col("src").alias("id"), weight.alias("part")).unionByName(g.e.select(F.col("dst").alias("id"), (weight * 0.6).alias("part")))
    sums = ends.groupBy("id").agg(F.sum("part").alias("sum"))
    most = F.broadcast(between.agg(F.greatest(F.max("betweenness"), F.lit(0.001)).alias("most")))
    scored = sums.join(between, "id", "left").join(most, how="left").select("id", (F.col("sum") + F.coalesce(F.col("betweenness") / F.col("most"), F.lit(0.0)) * 15).alias("score"))
    return scored.orderBy(F.desc(F.round("score", 6)), "id").limit(top)


def health(g: Graph) -> DataFrame:
    """score, of diversity of groups and labels and of edges for each vertex; over 100 with eight groups."""
    v = g.v.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(shown_group()).alias("groups"))
    label = F.when(F.col("label") != "", F.col("label"))
    e = g.e.agg(F.count(F.lit(1)).alias("m"), F.count(label).alias("labels"), F.count_distinct(label).alias("kinds"))
    kinds = F.when(F.col("labels") > 0, F.least(F.lit(1.0), F.col("kinds") / F.col("labels"))).otherwise(0.0)
    dense = F.when(F.col("n") > 0, F.least(F.lit(1.0), F.col("m") / F.col("n") / 3)).otherwise(0.0)
    groups = F.col("groups") / 7
    return v.join(F.broadcast(e)).select(
        F.bround(groups * 33 + kinds * 33 + dense * 34).cast("int").alias("score"), F.round(groups, 4).alias("group_diversity"), F.round(kinds, 4).alias("label_diversity"), F.round(dense, 4).alias("edge_density"),
        (groups < 0.6).alias("needs_groups"), (kinds < 0.5).alias("needs_labels"),
    )


def edge_taxonomy(g: Graph) -> DataFrame:
    """category, label, n: labels by the first category that matches."""
    return g.e.groupBy(F.coalesce("label", F.lit("unknown")).alias("label")).agg(F.count(F.lit(1)).alias("n")).select(predicates.taxonomy(F.col("label")).alias("category"), "label", "n")


def influence(g: Graph, between: DataFrame, top: int = 10) -> DataFrame:
    """id, influence: the mean of degree centrality and betweenness, 4 places. between: id, betweenness."""
    score = F.round(0.5 * F.col("centrality") + 0.5 * F.coalesce("betweenness", F.lit(0.0)), 4)
    return degree_centrality(g).join(between, "id", "left").select("id", score.alias("influence")).orderBy(F.desc("influence"), "id").limit(top)


def entity_risk(g: Graph, between: DataFrame, forecasts: DataFrame | None = None) -> DataFrame:
    """id, risk (0 to 100): tension 0.4, betweenness 0.2, hostile share of edges out 0.2, forecasts 0.2.

    forecasts: actor, probability; an actor's are added up and divided by the largest sum.
    """
    own = g.e.groupBy(F.col("src").alias("id")).agg(F.avg(predicates.hostile(F.col("label")).cast("double")).alias("hostile"))
    rows = g.v.select("id").join(country_tension(g).select("id", "score"), "id", "left").join(between, "id", "left").join(own, "id", "left")
    part = F.lit(0.0)
    if forecasts is not None:
        sums = forecasts.groupBy(F.col("actor").alias("id")).agg(F.sum("probability").alias("forecast"))
        most = F.broadcast(sums.agg(F.max("forecast").alias("most")))
        rows = rows.join(sums, "id", "left").join(most, how="left")
        part = F.coalesce(F.try_divide(F.col("forecast"), F.col("most")), F.lit(0.0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return rows.select("id", F.round((zero("score") / 100 * 0.4 + zero("betweenness") * 0.2 + zero("hostile") * 0.2 + part * 0.2) * 100, 1).alias("risk"))


def stability(g: Graph, risks: DataFrame) -> DataFrame:
    """stability and risk of the whole graph. risks: id, risk."""
    mean = risks.agg(F.avg("risk").alias("mean"))
    risk = F.col("mean") * 0.6 + F.col("ratio") * 100 * 0.4
    row = hostile_ratio(g).join(F.broadcast(mean)).select(F.coalesce(risk, F.lit(0.0)).alias("risk")).withColumn("stability", F.round(100 - F.least("risk", F.lit(100.0)), 1))
    s = F.col("stability")
    return row.select("stability", F.round("risk", 1).alias("risk"), F.when(s < 25, "CRITICAL").when(s < 50, "HIGH RISK").when(s < 75, "MODERATE").otherwise("STABLE").alias("label"))


def vis_nodes(g: Graph) -> DataFrame:
    """id, group, colour and an HTML tooltip, escaped."""
    colours = F.create_map(*(F.lit(x) for kv in vocab.GROUP_COLOURS.items() for x in kv))
    colour = F.coalesce(F.try_element_at(colours, shown_group()), F.lit(vocab.GROUP_UNKNOWN_COLOUR))
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))
    lines = F.transform(F.map_entries(F.coalesce("attributes", F.create_map().cast("map<string,string>"))), lambda x: F.concat(esc(x["key"]), F.lit(": "), esc(F.coalesce(x["value"], F.lit("")))))
    text = F.concat_ws("<br>", F.concat(F.lit("<b>"), esc(F.upper(shown_group())), F.lit("</b>")), lines, F.concat(F.lit("confidence: "), F.format_string("%.2f", shown_confidence())))
    return g.v.select("id", shown_group().alias("grp"), colour.alias("colour"), text.alias("tooltip"), shown_confidence().alias("confidence"))


def vis_edges(g: Graph) -> DataFrame:
    return g.e.select("src", "dst", F.coalesce("label", F.lit("")).alias("label"), shown_confidence().alias("confidence"))


def health_by_sources(g: Graph, evidence: DataFrame, days_since_ingest: float) -> DataFrame:
    """score of 100: diversity of groups, labels and sources, and recency, a quarter each. evidence: id, source."""
    v = g.v.agg(F.count_distinct(shown_group()).alias("groups"))
    e = g.e.agg(F.count(F.lit(1)).alias("m"), F.count_distinct(F.coalesce("label", F.lit(""))).alias("kinds"))
    per = evidence.groupBy("id").agg(F.count_distinct("source").alias("n")).agg(F.coalesce(F.avg("n"), F.lit(0.0)).alias("per"))
    recency = max(0.0, 1 - days_since_ingest / 30)
    row = v.join(F.broadcast(e)).join(F.broadcast(per))
    kinds = F.least(F.lit(1.0), F.col("kinds") / F.greatest(F.col("m") * 0.3, F.lit(1.0)))
    sources = F.least(F.lit(1.0), F.col("per") / 3)
    return row.select(F.bround(F.col("groups") / 7 * 25 + kinds * 25 + sources * 25 + recency * 25).cast("int").alias("score"), F.round(sources, 4).alias("source_diversity"), F.lit(recency).alias("recency"))


def with_threshold(thresholds: DataFrame, id_: str, value: float) -> DataFrame:
    """The threshold table (id, threshold) with one set."""
    one = thresholds.sparkSession.createDataFrame([(id_, float(value))], "id string, threshold double")
    return thresholds.filter(F.col("id") != id_).unionByName(one)


def save_thresholds(thresholds: DataFrame, path: str) -> None:
    thresholds.select("id", "threshold").write.mode("overwrite").parquet(path)


def load_thresholds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, threshold double").parquet(path)
