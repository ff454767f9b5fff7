"""The registered queries of the graph engine, and the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import fixtures, predicates, vocab
from weftgraph.functions import temporal as T
from weftgraph.functions import text as X
from weftgraph.functions import extract as X2
from weftgraph.functions.extract import lexicon_extractor, parse_answers
from weftgraph.graph import EDGES, VERTICES, Graph, conform
from weftgraph.operators import analytics as A
from weftgraph.operators import mutate as M
from weftgraph.operators import paths as P
from weftgraph.operators import relational as R
from weftgraph.operators import trees
from weftgraph.operators import vectors as V
from weftgraph.plans import gql
from weftgraph.sources import documents as D
from weftgraph.sources import nodelink as N
from weftgraph.sources import sinks as S
from weftgraph.stage import new_path, table
from weftgraph.streaming import windows as W

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _words(words) -> str:
    return "|".join(words)


def _hostile(label: str) -> str:
    return f"regexp_matches(lower(coalesce({label}, '')), '{_words(vocab.HOSTILE)}')"


def _coop(label: str) -> str:
    return f"regexp_matches(lower(coalesce({label}, '')), '{_words(vocab.COOPERATIVE)}')"


SCORE = (
    f"case when regexp_matches(lower(label), '{_words(vocab.TENSION_HIGH)}') then 18.0::double when regexp_matches(lower(label), '{_words(vocab.TENSION_MEDIUM)}') then 9.0::double "
    f"when regexp_matches(lower(label), '{_words(vocab.TENSION_COOP)}') then -3.0::double else 2.0::double end"
)
DEGREE = "deg as (select v.id, v.grp, count(x.id) as degree from v left join (select src as id from e union all select dst from e) x on x.id = v.id group by v.id, v.grp)"
TENSION = f"""
parts as (select src as id, {SCORE} * 1.2 as part from e union all select dst, {SCORE} * 0.9 from e),
raw as (select v.id, coalesce(sum(part), 0) * (1 + 0.04 * least(count(part), 20)) as raw, count(part) as degree from v left join parts p on p.id = v.id where v.grp = 'country' group by v.id),
tension as (select id, degree, greatest(0.0, least(100.0, raw / (select greatest(max(raw), 1.0) from raw) * 100)) as score from raw)"""
#: Shortest paths by walks: as many walks of the least length as there are shortest paths. No path of the graph has nine steps.
BETWEEN = """
arcs as (select distinct src, dst from e where src <> dst), size_ as (select count(*)::double as n from v),
walk(s, t, d, n) as (select src, dst, 1, 1.0::double from arcs union all select s, dst, d + 1, sum(n) from walk join arcs on t = src where d < 9 group by s, dst, d),
short as (select s, t, min(d) as d from walk where s <> t group by s, t), sigma as (select s, t, d, n from walk join short using (s, t, d)),
inner_ as (select a.t as id, sum(a.n * b.n / c.n) as part from sigma a join sigma b on a.t = b.s join sigma c on c.s = a.s and c.t = b.t where a.d + b.d = c.d group by a.t),
bc as (select v.id, coalesce(part, 0) / ((n - 1) * (n - 2)) as betweenness from v left join inner_ i on i.id = v.id, size_)"""
LABELS = """
both_ways as (select src as a, dst as b from e union select dst, src from e),
wcc(id, root) as (select id, id from v union select b.b, w.root from wcc w join both_ways b on b.a = w.id where w.root < b.b),
labels_ as (select id, min(root) as component from wcc group by id)"""


def graph(name: str, sql: str | None = None, *ctes: str, recursive: bool = False):
    """Registers a query over the fixture graph, and its SQL over v(id, grp, confidence) and e(src, dst, label, confidence)."""

    def add(f: Callable[[Graph], DataFrame]):
        QUERIES[name], told = graph_query(f, sql, ctes, recursive)
        if told:
            SQL[name] = told
        return f

    return add


def graph_query(f: Callable[[Graph], DataFrame], sql: str | None, ctes: tuple[str, ...], recursive: bool) -> tuple[Query, str | None]:
    """f over the fixture graph, and its SQL after what defines that."""
    told = f"with {'recursive ' if recursive else ''}{', '.join((fixtures.CTES, *ctes))} {sql}" if sql else None
    return lambda spark, sf_dir: f(fixtures.build(spark, sf_dir)), told


def tables(name: str, sql: str | None = None):
    def add(f: Query):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# -- the query language ---------------------------------------------------------------------------

_GROUP = "rtrim(lower(grp), 's')"
GQL = {
    "gql_find_country": ("find countries", "select id, grp, confidence from v where grp = 'country' order by id limit 200"),
    "gql_find_technologies": ("find technologies", "select id, grp, confidence from v where grp = 'technology' order by id limit 200"),
    "gql_find_that_predicate": ("find countries that cooperates nation_6", "select id, grp, confidence from v where grp = 'country' and id in (select src from e where contains(label, 'cooperates') and dst = 'NATION_6')"),
    "gql_neighbors": (
        "neighbors of nation_6",
        "select id, case when max(o) = 1 and max(i) = 1 then 'both' when max(o) = 1 then 'out' else 'in' end as direction, any_value(grp) as grp from "
        "(select dst as id, 1 as o, 0 as i from e where src = 'NATION_6' union all select src, 0, 1 from e where dst = 'NATION_6') join v using (id) group by id order by id limit 200",
    ),
    "gql_successors": ("successors of nation_6", "select src, dst, label, confidence from e where src = 'NATION_6' order by src, dst limit 200"),
    "gql_predecessors": ("predecessors of nation_6", "select src, dst, label, confidence from e where dst = 'NATION_6' order by src, dst limit 200"),
    "gql_edges_between": ("edges between nation_6 and nation_14", "select src, dst, label, confidence from e where (src, dst) in (('NATION_6', 'NATION_14'), ('NATION_14', 'NATION_6'))"),
    "gql_count_between": ("count relationships between nation_6 and nation_14", "select count(*) as n from e where (src, dst) in (('NATION_6', 'NATION_14'), ('NATION_14', 'NATION_6'))"),
    "gql_edges_label": ("edges where label contains sanctions", "select src, dst, label, confidence from e where contains(label, 'sanctions') order by src, dst limit 200"),
    "gql_confidence_ge": ("nodes with confidence >= 0.9", "select id, confidence, grp from v where confidence >= 0.9 order by id limit 200"),
    "gql_count_group": ("count persons", "select 'persons' as grp, count(*) as n from v where grp = 'person'"),
    "gql_count_entities": ("count entities", "select 'entities' as grp, count(*) as n from v"),
    "gql_degree_gt": ("nodes with degree > 8", f"select id, degree, grp from deg where degree > 8 order by degree desc, id limit 200"),
    "gql_hubs": ("hub nodes", "select id, degree, grp from deg where degree >= 3 order by degree desc, id limit 200"),
    "gql_isolated": ("isolated nodes", "select id, grp from deg where degree = 0 order by id limit 200"),
    "gql_top_degree": ("top 5 nodes by degree", "select id, degree, grp from deg order by degree desc, id limit 5"),
}


def _gql(name: str, text: str, sql: str) -> None:
    graph(name, sql, DEGREE)(lambda g: gql.run(g, text))


for _name, (_text, _sql) in GQL.items():
    _gql(_name, _text, _sql)

_PATHS = """arcs as ({arcs}), p(id, path, len) as (select '{a}', '{a}', 0 union all
  select a.y, p.path || '>' || a.y, p.len + 1 from p join arcs a on a.x = p.id where p.len < 4 and not contains('>' || p.path || '>', '>' || a.y || '>')),
hits as (select path, len from p where id = '{b}')"""
_OUT, _BOTH = "select src as x, dst as y from e", "select src as x, dst as y from e union select dst, src from e"
graph("gql_path", "select path, cast(len as bigint) as length, true as directed from hits order by len, path limit 1", _PATHS.format(arcs=_OUT, a="Supplier#000000001", b="NATION_6"), recursive=True)(
    lambda g: gql.run(g, "path from supplier#000000001 to nation_6").drop("narrative")
)
graph("gql_path_undirected", "select path, cast(len as bigint) as length, false as directed from hits order by len, path limit 1", _PATHS.format(arcs=_BOTH, a="AFRICA", b="Supplier#000000001"), recursive=True)(
    lambda g: gql.run(g, "path from africa to supplier#000000001").drop("narrative")
)
graph("all_simple_paths", "select path, cast(len as bigint) as length from hits order by len, path limit 10", _PATHS.format(arcs=_OUT, a="NATION_6", b="NATION_14"), recursive=True)(lambda g: P.all_simple_paths(g, "NATION_6", "NATION_14"))

# -- whole-graph results --------------------------------------------------------------------------

graph("isolated_nodes", "select id, grp from deg where degree = 0", DEGREE)(lambda g: R.isolated(g).select("id", "grp"))
graph("degrees", "select id, grp, degree from deg", DEGREE)(lambda g: R.degree(g).select("id", "grp", "degree"))
graph("degree_centrality", "select id, round(degree / (select count(*) - 1 from v), 6) as centrality from deg", DEGREE)(lambda g: A.degree_centrality(g).select("id", F.round("centrality", 6).alias("centrality")))
graph("group_counts", "select grp, count(*) as n from v group by grp")(R.group_counts)
graph("composition_table", "select upper(grp[1]) || grp[2:] as entity_type, count(*) as n from v group by grp")(R.composition)
graph("group_confidence_rollup", "select grp, cast(floor(confidence * 10) as bigint) as tenth, count(*) as n from v group by rollup (grp, tenth)")(R.group_confidence_rollup)
graph("graph_totals", "select (select count(*) from v) as n_nodes, (select count(*) from e) as n_edges, round((select count(*) from e) / ((select count(*) from v)::double * ((select count(*) from v) - 1)), 4) as density")(A.totals)
graph(
    "health",
    "select cast(round_even(g * 33 + k * 33 + d * 34, 0) as int) as score, round(g, 4) as group_diversity, round(k, 4) as label_diversity, round(d, 4) as edge_density, g < 0.6 as needs_groups, k < 0.5 as needs_labels from "
    "(select (select count(distinct grp) from v) / 7.0::double as g, least(1.0, count(distinct label) / count(label)::double) as k, least(1.0, count(*) / (select count(*) from v)::double / 3) as d from e)",
)(A.health)
graph("country_tension", "select id, round(score, 4) as score, 75.0::double as threshold, score >= 75 as alert from tension", TENSION)(lambda g: A.country_tension(g).select("id", F.round("score", 4).alias("score"), "threshold", "alert"))


def _thresholds(g: Graph) -> DataFrame:
    return g.v.filter("`group` = 'country'").select("id", F.when(F.col("confidence") > 0.75, 30.0).otherwise(60.0).alias("threshold"))


graph("tension_alerts", "select id, round(score, 4) as score, threshold from (select id, score, case when confidence > 0.75 then 30.0::double else 60.0::double end as threshold from tension join v using (id)) where score >= threshold", TENSION)(
    lambda g: A.country_tension(g, _thresholds(g)).filter("alert").select("id", F.round("score", 4).alias("score"), "threshold")
)


def _places(g: Graph) -> DataFrame:
    """The k-th nation lies where the gazetteer's k-th name does."""
    return g.spark.createDataFrame([(f"NATION_{i}", lat, lon) for i, (_, lat, lon) in enumerate(vocab.GAZETTEER[:25])], "id string, lat double, lon double")


_places_sql = ", ".join(f"('NATION_{i}', {lat}::double, {lon}::double)" for i, (_, lat, lon) in enumerate(vocab.GAZETTEER[:25]))
_colour = "case " + " ".join(f"when score >= {x} then '{c}'" for x, c in vocab.TENSION_COLOURS) + f" else '{vocab.TENSION_CALM}' end"
graph(
    "geo_markers",
    f"""select t.id, lat, lon, 'country' as grp, round(score, 1) as tension, {_colour} as colour, 75.0::double as threshold, score >= 75 as alert, coalesce(c.connections, '') as connections, t.degree
    from tension t join (values {_places_sql}) p(id, lat, lon) on p.id = t.id left join texts c on c.id = t.id""",
    TENSION,
    """sides as (select src as id, 0 as side, label || ' ' || dst as text, dst as other from e union all select dst, 1, src || ' ' || label, src from e),
    texts as (select id, string_agg(text, '; ' order by rn) as connections from (select *, row_number() over (partition by id order by side, other) as rn from sides) where rn <= 5 group by id)""",
)(lambda g: A.geo_markers(g, _places(g)))

_PAIRS = "pairs as (select x.src as a, x.dst as b, x.label as label_ab, y.label as label_ba from e x join e y on x.src = y.dst and x.dst = y.src where x.src <= x.dst)"
graph("conflicts", f"select * from pairs where ({_hostile('label_ab')} and {_coop('label_ba')} and not {_hostile('label_ba')}) or ({_hostile('label_ba')} and {_coop('label_ab')} and not {_hostile('label_ab')})", _PAIRS)(A.conflicts)
graph("reciprocal_hostility", f"select * from pairs where {_hostile('label_ab')} and {_hostile('label_ba')}", _PAIRS)(A.reciprocal_hostility)
_TRIANGLES = f"""h as (select src, dst from e where {_hostile("label")}),
tri as (select distinct list_sort([x.src, x.dst, y.dst]) as t from h x join h y on x.dst = y.src left join e f on f.src = x.src and f.dst = y.dst left join e b on b.src = y.dst and b.dst = x.src
  where x.src <> x.dst and x.src <> y.dst and x.dst <> y.dst and coalesce(case when f.label is not null then {_hostile("f.label")} end, case when b.label is not null then {_hostile("b.label")} end, false))"""
graph("conflict_triangles", "select t[1] as a, t[2] as b, t[3] as c from tri", _TRIANGLES)(A.conflict_triangles)
graph(
    "unstable_triangles",
    "select x.x as a, x.y as b, y.y as c from side x join side y on x.y = y.x join side z on z.x = x.x and z.y = y.y where x.kind + y.kind + z.kind = 2",
    f"side as (select * from (select least(src, dst) as x, greatest(src, dst) as y, case when bool_or({_hostile('label')}) then 1 when bool_or({_coop('label')}) then 0 end as kind from e where src <> dst group by 1, 2) where kind is not null)",
)(A.unstable_triangles)
graph("hostile_ratio", f"select round(avg(case when {_hostile('label')} then 1.0 else 0.0 end), 6) as ratio from e")(lambda g: A.hostile_ratio(g).select(F.round("ratio", 6).alias("ratio")))
graph(
    "global_risk",
    "select round(raw, 1) as risk, case when raw >= 75 then 'CRITICAL' when raw >= 50 then 'HIGH' when raw >= 25 then 'MEDIUM' else 'LOW' end as label, round(ratio, 3) as ratio, p as n_reciprocal, t as n_triangles "
    "from (select *, least(100.0, least(p * 12.0, 40.0) + least(t * 8.0, 24.0) + ratio * 36.0) as raw from "
    f"(select (select count(*) from pairs where {_hostile('label_ab')} and {_hostile('label_ba')}) as p, (select least(count(*), 5) from tri) as t, (select avg(case when {_hostile('label')} then 1.0::double else 0.0::double end) from e) as ratio))",
    _PAIRS,
    _TRIANGLES,
)(A.global_risk)
graph("edge_taxonomy", "select case " + " ".join(f"when regexp_matches(lower(label), '{p}') then '{n}'" for n, p in vocab.TAXONOMY) + " else 'Other' end as category, label, count(*) as n from e group by label")(A.edge_taxonomy)
graph("canonical_labels", "select src, dst, case " + " ".join(f"when regexp_matches(lower(label), '{p}') then '{n}'" for n, p in vocab.CANONICAL_LABELS) + " else label end as label from e")(
    lambda g: g.e.select("src", "dst", predicates.canonical_label(F.col("label")).alias("label"))
)
graph("vis_edges", "select src, dst, label, confidence from e")(A.vis_edges)
graph("vis_nodes", "select id, grp, case grp " + " ".join(f"when '{k}' then '{c}'" for k, c in vocab.GROUP_COLOURS.items()) + " end as colour, '<b>' || upper(grp) || '</b><br>confidence: ' || printf('%.2f', confidence) as tooltip, confidence from v")(A.vis_nodes)
graph(
    "edge_sample",
    "select line, hub from (select src, dst, src || ' -[' || label || ']-> ' || dst as line, src in (select id from top_) or dst in (select id from top_) as hub from e) order by hub desc, src, dst limit 25",
    DEGREE,
    "top_ as (select id from deg order by degree desc, id limit 10)",
)(R.edge_sample)

# -- iterative ------------------------------------------------------------------------------------

def _between(g: Graph) -> tuple[Graph, DataFrame]:
    whole = g.staged()
    return whole, P.betweenness(whole)


graph("top_betweenness", "select id, round(betweenness, 4) as betweenness, grp from bc join v using (id) order by 2 desc, id limit 8", BETWEEN, recursive=True)(lambda g: P.top_betweenness(g.staged(), 8))
graph("influence_rank", "select id, round(0.5 * degree / (n - 1) + 0.5 * betweenness, 4) as influence from bc join deg using (id), size_ order by influence desc, id limit 10", BETWEEN, DEGREE, recursive=True)(lambda g: A.influence(*_between(g)))
graph(
    "hotspots",
    f"""select id, round(sum(part) + any_value(betweenness) / (select greatest(max(betweenness), 0.001) from bc) * 15, 4) as score from
    (select src as id, {{w}} as part from e union all select dst, {{w}} * 0.6 from e) join bc using (id) group by id order by score desc, id limit 8""".format(w=f"case when {_hostile('label')} then 3.0::double when {_coop('label')} then -1.0::double else 0.5::double end"),
    BETWEEN,
    recursive=True,
)(lambda g: A.hotspots(*_between(g)).select("id", F.round("score", 4).alias("score")))
graph("wcc_labels", "select id, component from labels_", LABELS, recursive=True)(P.wcc)
graph("wcc_count", "select count(distinct component) as components from labels_", LABELS, recursive=True)(P.wcc_count)
_EGO = "both_ as (select src as a, dst as b from e union select dst, src from e), near as (select 'NATION_6' as id union select b from both_ where a = 'NATION_6' union select y.b from both_ x join both_ y on x.b = y.a where x.a = 'NATION_6')"
graph("ego_2hop", "select src, dst, label from e where src in (select id from near) and dst in (select id from near)", _EGO)(lambda g: P.ego(g, "NATION_6", 2).e.select("src", "dst", "label"))
graph("context_edges", "select src, dst, label from e where src in (select id from near) or dst in (select id from near)", _EGO)(
    lambda g: P.context_edges(g, g.spark.createDataFrame([("NATION_6",)], "id string"), 2).select("src", "dst", "label")
)
graph(
    "node_removal_impact",
    """select 'NATION_6' as removed, (select count(distinct component) from labels_) as before, (select count(distinct component) from labels2) as after,
    (select count(distinct component) from labels2) > (select count(distinct component) from labels_) as fragments, count(*) as orphans, string_agg(id, ',' order by id) as orphan_ids
    from (select distinct x.id from (select src as id from e where dst = 'NATION_6' union select dst from e where src = 'NATION_6') x where x.id <> 'NATION_6' and not exists (select 1 from e2 where src = x.id or dst = x.id))""",
    LABELS,
    """e2 as (select * from e where src <> 'NATION_6' and dst <> 'NATION_6'), both2 as (select src as a, dst as b from e2 union select dst, src from e2),
    wcc2(id, root) as (select id, id from v where id <> 'NATION_6' union select b.b, w.root from wcc2 w join both2 b on b.a = w.id where w.root < b.b),
    labels2 as (select id, min(root) as component from wcc2 group by id)""",
    recursive=True,
)(lambda g: P.node_removal(g.staged(), "NATION_6"))
graph(
    "bridge_edges",
    "select a, b from lines l where not exists (select 1 from around r where r.a = l.a and r.b = l.b and r.id = l.b)",
    """both_ways as (select src as a, dst as b from e union select dst, src from e), lines as (select distinct least(src, dst) as a, greatest(src, dst) as b from e where src <> dst),
    around(a, b, id) as (select a, b, a from lines union select r.a, r.b, w.b from around r join both_ways w on w.a = r.id where not (least(w.a, w.b) = r.a and greatest(w.a, w.b) = r.b))""",
    recursive=True,
)(trees.bridges)
_RISK = f"""risks as (select id, round((coalesce(score, 0) / 100 * 0.4 + betweenness * 0.2 + coalesce(h, 0) * 0.2) * 100, 1) as risk from bc left join tension using (id)
    left join (select src as id, avg(case when {_hostile("label")} then 1.0::double else 0.0::double end) as h from e group by src) using (id))"""
graph("entity_risk", "select id, risk from risks", BETWEEN, TENSION, _RISK, recursive=True)(lambda g: A.entity_risk(*_between(g)))


@graph(
    "stability",
    """select round(100 - least(r, 100.0), 1) as stability, round(r, 1) as risk, case when round(100 - least(r, 100.0), 1) < 25 then 'CRITICAL' when round(100 - least(r, 100.0), 1) < 50 then 'HIGH RISK'
    when round(100 - least(r, 100.0), 1) < 75 then 'MODERATE' else 'STABLE' end as label from whole""",
    BETWEEN,
    TENSION,
    _RISK,
    f"whole as (select (select avg(risk) from risks) * 0.6 + (select avg(case when {_hostile('label')} then 1.0::double else 0.0::double end) from e) * 100 * 0.4 as r)",
    recursive=True,
)
def _stability(g: Graph) -> DataFrame:
    whole, b = _between(g)
    return A.stability(whole, A.entity_risk(whole, b))


@graph(
    "structural_similarity",
    """select f.id, round(list_cosine_similarity(f.x, o.x), 3) as similarity from f, (select x from f where id = 'NATION_6') o
    where f.id <> 'NATION_6' and list_sum(f.x) > 0 order by list_cosine_similarity(f.x, o.x) desc, f.id limit 5""",
    BETWEEN,
    DEGREE,
    f"""f as (select deg.id, [degree / (n - 1), betweenness, coalesce(h, 0) / greatest(degree, 1), coalesce(c, 0) / greatest(degree, 1), coalesce(r, 0) / n] as x from deg join bc using (id)
    left join (select src as id, sum(cast({_hostile("label")} as int))::double as h, sum(cast({_coop("label")} as int))::double as c from e group by src) using (id)
    left join (select s as id, count(*)::double as r from short group by s) using (id), size_)""",
    recursive=True,
)
def _structural(g: Graph) -> DataFrame:
    whole, b = _between(g)
    top = V.cosine_topk(P.structural_features(whole, b), "id", "features", "NATION_6", 5)
    return top.select("id", F.round("similarity", 3).alias("similarity"))


# -- changes --------------------------------------------------------------------------------------

graph(
    "merge_nodes",
    "select src, dst, min_by(label, own) as label, case when count(*) > 1 then count(*)::double end as weight from moved where src <> dst group by src, dst",
    """moved as (select case when src = 'NATION_6' then 'NATION_14' else src end as src, case when dst = 'NATION_6' then 'NATION_14' else dst end as dst, label, case when src = 'NATION_6' or dst = 'NATION_6' then 1 else 0 end as own
    from e where not (src in ('NATION_6', 'NATION_14') and dst in ('NATION_6', 'NATION_14')))""",
)(lambda g: M.merge(g, "NATION_6", "NATION_14").e.select("src", "dst", "label", "weight"))


def _extractions(g: Graph) -> DataFrame:
    """Mentions made from the graph: each nation again, and for each trade edge two relationships, of which the second stays."""
    nation = g.v.filter("`group` = 'country'").select(F.lit("country").alias("class"), F.col("id").alias("text"), F.create_map().cast("map<string,string>").alias("attributes"), F.lit(0.95).alias("confidence"), F.lit(0).cast("bigint").alias("pos"))
    trade = g.e.filter("label = 'monitors'")
    ends = F.create_map(F.lit("source"), "src", F.lit("target"), "dst")
    rels = [trade.select(F.lit("relationship").alias("class"), F.lit(label).alias("text"), ends.alias("attributes"), F.lit(c).alias("confidence"), F.lit(p).cast("bigint").alias("pos")) for label, c, p in (("watches", 0.7, 1), ("observes", 0.8, 2))]
    stub = g.spark.createDataFrame([("relationship", "visits", {"source": "NATION_0", "target": "Atlantis Republic"}, 0.9, 3)], "class string, text string, attributes map<string,string>, confidence double, pos bigint")
    return nation.unionByName(rels[0]).unionByName(rels[1]).unionByName(stub)


graph("upsert_last_write_wins", "select src, dst, label, round(confidence, 2) as confidence from (select src, dst, case when label = 'monitors' then 'observes' else label end as label, case when label = 'monitors' then 0.8 else confidence end as confidence from e union all select 'NATION_0', 'Atlantis Republic', 'visits', 0.9)")(
    lambda g: M.upsert(g, _extractions(g)).graph.e.select("src", "dst", "label", F.round("confidence", 2).alias("confidence"))
)
graph("upsert_vertices", "select id, grp, round(greatest(confidence, case when grp = 'country' then 0.95 else 0 end), 2) as confidence from v union all select 'Atlantis Republic', 'unknown', null")(
    lambda g: M.upsert(g, _extractions(g)).graph.v.select("id", F.col("group").alias("grp"), F.round("confidence", 2).alias("confidence"))
)


def _later(g: Graph) -> Graph:
    """The graph after trade edges end, new labels come, and low confidences go."""
    e = g.e.filter("label <> 'monitors'").withColumn("label", F.when(F.col("label") == "threatens", "attacks").otherwise(F.col("label")))
    return Graph(g.v.filter("confidence >= 0.55"), e)


graph(
    "graph_diff",
    """select 'node' as item, id as key, 'removed' as status from v where confidence < 0.55 union all select 'edge', src || '>' || dst, 'removed' from e where label = 'monitors'
    union all select 'edge', src || '>' || dst, 'changed' from e where label = 'threatens'""",
)(lambda g: M.diff(g, _later(g)))
graph("workspace_recurrence", "select id, string_agg(w, ',' order by w) as workspaces, count(*) as n from (select id, 'a' as w from v union all select id, 'b' from v where confidence >= 0.55) group by id having count(*) >= 2")(lambda g: M.recurrence({"a": g, "b": _later(g)}))


@graph("scenario_changes", "select src, dst, label from e where label <> 'monitors' and not (src = 'NATION_0' and dst = 'NATION_24') union all select 'NATION_0', 'NATION_24', 'blockades'")
def _scenario(g: Graph) -> DataFrame:
    add = g.spark.createDataFrame([("NATION_0", "NATION_24", "blockades", 0.9)], "src string, dst string, label string, confidence double")
    return M.apply_changes(g, add, g.e.filter("label = 'monitors' or (src = 'NATION_0' and dst = 'NATION_24')")).e.select("src", "dst", "label")




@graph("fuzzy_resolve", "select lower(id) || suffix as name, id from v, (values (''), ('x')) s(suffix)")
def _fuzzy(g: Graph) -> DataFrame:
    """The name of each vertex as it is and misspelt, which means that vertex and no other."""
    return M.resolve(g.v.select(F.explode(F.array(F.lower("id"), F.concat(F.lower("id"), F.lit("x")))).alias("name")), g.v)


@graph("similar_names")
def _similar(g: Graph) -> DataFrame:
    """Scores to four places; in doubles, as there are a great many and a ratio's halves are exact in them."""
    return M.similar_pairs(g.v).select("a", "b", (F.floor(F.col("score") * 10000 + 0.5) / 10000).alias("score"))


def _with_battles(g: Graph) -> Graph:
    """The graph with an event beside every fifth country."""
    at = g.v.filter("`group` = 'country' and id like '%5'")
    name = F.concat(F.lit("Battle of "), "id")
    v = g.v.unionByName(conform(at.select(name.alias("id"), F.lit("event").alias("group")), VERTICES))
    return Graph(v, g.e.unionByName(conform(at.select(F.col("id").alias("src"), name.alias("dst"), F.lit("hosts").alias("label")), EDGES)))


graph(
    "military_tension",
    "select id, round(score, 4) as score from tension",
    "e0 as (select src, dst, label, 0.0::double as bonus from e union all select id, 'Battle of ' || id, 'hosts', 7.0 from v where grp = 'country' and id like '%5')",
    TENSION.replace("from e union", "from e0 union").replace("from e0 union all select dst", "from e0 union all select dst").replace("0.9 from e)", "0.9 from e0)").replace("* 1.2 as part", "* 1.2 + bonus as part"),
)(lambda g: A.country_tension(_with_battles(g)).select("id", F.round("score", 4).alias("score")))
_TOLD = _PATHS.replace("p(id, path, len)", "p(id, path, len, told)").replace("'{a}', 0 union", "'{a}', 0, '{a}' union").replace("p.len + 1 from", "p.len + 1, p.told || ' → [' || a.label || '] → ' || a.y from")
graph(
    "path_narrative",
    "select told || '  (' || len || ' hops, directed)' as narrative from p where id = 'NATION_6' order by len, path limit 1",
    _TOLD.format(arcs="select src as x, dst as y, label from e", a="Supplier#000000001", b="NATION_6"),
    recursive=True,
)(lambda g: gql.run(g, "find path from supplier#000000001 to nation_6").select("narrative"))
graph("gql_ego", "select id, grp from v where id in (select id from near) order by id limit 200", _EGO)(lambda g: gql.run(g, "ego of nation_6 hops 2"))
graph("gql_edges_over_cap", "select 'edges_label' as kind, cast(least(count(*), 200) as int) as shown, count(*) as n, count(*) > 200 as truncated from e where contains(label, 'a')")(lambda g: _told(g, "edges where label contains a"))


def _told(g: Graph, text: str) -> DataFrame:
    a = gql.answer(g, text)
    return g.spark.createDataFrame([(a.kind, len(a.rows), a.count, a.truncated)], "kind string, shown int, n bigint, truncated boolean")




@graph("enrich_vertices", "select v.id, r_name as region, case when n_name is not null then 'table' end as origin, case when n_name is not null then 'kept' end as note from v left join nation on n_name = v.id left join region on n_regionkey = r_regionkey")
def _enriched(g: Graph) -> DataFrame:
    first = g.v.filter("`group` = 'country'").select("id", F.create_map(F.lit("region"), F.lit("?"), F.lit("note"), F.lit("kept")).alias("attributes"))
    second = g.e.filter("label = 'member of'").select(F.col("src").alias("id"), F.create_map(F.lit("region"), "dst", F.lit("origin"), F.lit("table")).alias("attributes"))
    a = F.col("attributes")
    return M.enrich(M.enrich(g, first), second).v.select("id", a["region"].alias("region"), a["origin"].alias("origin"), a["note"].alias("note"))


@graph(
    "auto_queries",
    """select 1 as place, 'neighbors of ' || a as query from ab union all select 2, 'path from ' || a || ' to ' || b from ab union all select 3, 'find countries' union all select 4, 'hub nodes'
    union all select 5, 'neighbors of ' || (select id from tension order by score desc, id limit 1)""",
    DEGREE,
    TENSION,
    "two as (select id, row_number() over (order by degree desc, id) as k from deg), ab as (select max(id) filter (k = 1) as a, max(id) filter (k = 2) as b from two where k < 3)",
)
def _automatic(g: Graph) -> DataFrame:
    return g.spark.createDataFrame(list(enumerate(gql.auto_queries(g, 0), 1)), "place int, query string")


graph(
    "health_by_sources",
    """select cast(round_even(g / 7.0 * 25 + k * 25 + s * 25 + 0.9 * 25, 0) as int) as score, round(s, 4) as source_diversity, 0.9::double as recency from
    (select (select count(distinct grp) from v)::double as g, least(1.0, count(distinct label) / greatest(count(*) * 0.3, 1.0)) as k, (select least(1.0, avg(n) / 3) from (select src, count(distinct dst) as n from e group by src)) as s from e)""",
)(lambda g: A.health_by_sources(g, g.e.select(F.col("src").alias("id"), F.col("dst").alias("source")), 3.0))
graph("totals_of_nothing", "select count(*) as n_nodes, (select count(*) from e where confidence < 0) as n_edges, case when count(*) > 1 then (select count(*) from e where confidence < 0) / (count(*) * (count(*) - 1)) else 0.0 end::double as density from v where confidence < 0")(
    lambda g: A.totals(Graph(g.v.filter("confidence < 0"), g.e.filter("confidence < 0")))
)
graph("entity_relation_split", "select (select count(*) from v where grp = 'country') as entities, (select 2 * count(*) + 1 from e where label = 'monitors') as relations")(lambda g: X2.entity_relation_split(_extractions(g)))
graph("delta_projection", "select src, dst, label from e where src in (select r_name from region) or dst in (select r_name from region)")(lambda g: _delta(g))
graph("delta_vertices", "select id from v where id in (select r_name from region)")(lambda g: _delta(g, True))


def _delta(g: Graph, vertices: bool = False) -> DataFrame:
    from weftgraph.streaming.ingest import delta

    d = delta(M.Change(g, g.e.filter("label = 'member of'").select(F.col("dst").alias("id")).distinct(), g.e))
    return d.v.select("id") if vertices else d.e.select("src", "dst", "label")


@graph("upsert_changes", "select 'node' as item, lower(replace(id, '_', ' of ')) as key from v where grp = 'country' union all select 'edge', 'NATION_0>Atlantis Republic'")
def _upsert_changes(g: Graph) -> DataFrame:
    """What an upsert says that it added: new entities, and the edge to an end that no entity names."""
    fresh = g.v.filter("`group` = 'country'").select(F.lit("treaty").alias("class"), F.lower(F.replace("id", F.lit("_"), F.lit(" of "))).alias("text"), F.create_map().cast("map<string,string>").alias("attributes"), F.lit(0.9).alias("confidence"), F.lit(9).cast("bigint").alias("pos"))
    c = M.upsert(g, _extractions(g).unionByName(fresh), threshold=1.0)
    return c.nodes_added.select(F.lit("node").alias("item"), F.col("id").alias("key")).unionByName(c.edges_added.select(F.lit("edge").alias("item"), F.concat_ws(">", "src", "dst").alias("key")))


graph("threshold_table", "select id, case when id = 'NATION_6' then 42.5::double else 60.0::double end as threshold from v where grp = 'country'")(lambda g: _threshold_table(g))


def _threshold_table(g: Graph) -> DataFrame:
    path = new_path(g.spark, "thresholds")
    rows = g.v.filter("`group` = 'country'").select("id", F.lit(60.0).alias("threshold"))
    A.save_thresholds(A.with_threshold(rows, "NATION_6", 42.5), path)
    return A.load_thresholds(g.spark, path)


graph(
    "context_lines",
    "select '- ' || src || ' → ' || label || ' → ' || dst || ' [confidence: ' || printf('%.2f', confidence) || ']' as line from (select * from e where src in (select id from near) or dst in (select id from near) order by src, dst limit 20)",
    _EGO,
)(lambda g: g.spark.createDataFrame([(x,) for x in X.context_text(g, "What about NATION_6?").split("\n")], "line string"))
graph(
    "event_timeline",
    """select 'Summit of ' || s.id as id, '2024-' || right(s.id, 1) as date, s.confidence, string_agg(actor, ',' order by actor) as actors from (select v.*, row_number() over (partition by v.id order by actor) as k, actor from v join
    (select src as n, dst as actor from e union select dst, src from e) x on x.n = v.id where grp = 'country') s where k <= 5 group by s.id, s.confidence""",
)(lambda g: _timeline(g))


def _timeline(g: Graph) -> DataFrame:
    """Each country as an event of its own, with a date."""
    name = lambda c: F.concat(F.lit("Summit of "), c)
    v = g.v.filter("`group` = 'country'").select(name("id").alias("id"), F.lit("Event").alias("group"), "confidence", F.create_map(F.lit("date"), F.concat(F.lit("2024-"), F.right("id", F.lit(1)))).alias("attributes"))
    ends = g.e.select(name("src").alias("src"), "dst").unionByName(g.e.select(name("dst").alias("src"), F.col("src").alias("dst")))
    return T.event_timeline(v, ends).select("id", "date", "confidence", F.array_join("actors", ",").alias("actors"))


# -- stores -----------------------------------------------------------------------------------------


@graph("node_link_round_trip", "select src, dst, label, round(confidence, 4) as confidence from e")
def _node_link(g: Graph) -> DataFrame:
    path = new_path(g.spark, "node-link")
    N.save(g, path)
    return N.load_saved(g.spark, path).e.select("src", "dst", "label", F.round("confidence", 4).alias("confidence"))


@graph("snapshot_timeline", "select * from (values ('2024-01-01T000000Z', 1, (select count(*) from v)), ('2024-01-01T000100Z', 2, (select count(*) from v where confidence >= 0.55))) t(stamp, place, n_nodes)")
def _snapshots(g: Graph) -> DataFrame:
    """Two snapshots a minute apart and one too soon, which isn't taken."""
    root = new_path(g.spark, "timeline")
    S.save_snapshot(g, root, datetime(2024, 1, 1))
    S.save_snapshot(_later(g), root, datetime(2024, 1, 1, 0, 0, 20))
    S.save_snapshot(_later(g), root, datetime(2024, 1, 1, 0, 1))
    rows = [(x, i, S.load_snapshot(g.spark, root, x).v.count()) for i, x in enumerate(S.snapshots(g.spark, root, newest_first=False), 1)]
    return g.spark.createDataFrame(rows, "stamp string, place int, n_nodes bigint")


@graph("store_round_trip", "select src, dst, label, confidence from e")
def _store(g: Graph) -> DataFrame:
    from weftgraph.streaming.store import GraphStore

    store = GraphStore(g.spark, new_path(g.spark, "store"))
    store.save(0, g, g.v.select(F.col("id").alias("key")))
    return store.load(0)[0].e.select("src", "dst", "label", "confidence")


# -- exports --------------------------------------------------------------------------------------

graph("edge_csv", "select src as source, dst as target, label, cast(confidence as varchar) as confidence from e")(S.edge_csv)
graph(
    "dossier_topn",
    """select v.id, v.grp, v.confidence, o.lines as outgoing, i.lines as incoming from v
    left join (select src as id, string_agg('- ' || src || ' → *' || label || '* → **' || dst || '**', chr(10) order by dst) as lines from (select *, row_number() over (partition by src order by dst) as rn from e) where rn <= 10 group by src) o on o.id = v.id
    left join (select dst as id, string_agg('- **' || src || '** → *' || label || '* → ' || dst, chr(10) order by src) as lines from (select *, row_number() over (partition by dst order by src) as rn from e) where rn <= 10 group by dst) i on i.id = v.id
    where grp = 'country'""",
)(lambda g: S.dossiers(g, g.v.filter("`group` = 'country'")).select("id", "grp", "confidence", F.array_join("outgoing", "\n").alias("outgoing"), F.array_join("incoming", "\n").alias("incoming")))
graph(
    "note_vault",
    "select v.id, '# ' || v.id || chr(10) || 'type: ' || v.grp || coalesce(chr(10) || l.links, '') as note from v left join (select src as id, string_agg('- ' || label || ' [[' || dst || ']]', chr(10) order by '- ' || label || ' [[' || dst || ']]') as links from e group by src) l on l.id = v.id",
)(S.note_vault)
_xml = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')".format
graph(
    "graphml_rows",
    f"""select 0 as part, '{S.GRAPHML_HEAD}' as value union all select 3, '</graph></graphml>'
    union all select 1, '<node id="' || {_xml("id")} || '"><data key="n_group">' || {_xml("grp")} || '</data><data key="n_confidence">' || confidence::varchar || '</data></node>' from v
    union all select 2, '<edge source="' || {_xml("src")} || '" target="' || {_xml("dst")} || '"><data key="e_label">' || {_xml("label")} || '</data><data key="e_confidence">' || confidence::varchar || '</data></edge>' from e""",
)(S.graphml_rows)

# -- documents ------------------------------------------------------------------------------------

tables("chunk_documents")(lambda spark, sf: X.chunk_rows(table(spark, sf, "documents")))
tables("html_text")(lambda spark, sf: D.pages_text(table(spark, sf, "pages")))
_strip = "trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\f\\r\\x0b]{2,}', ' ', 'g'))"
tables("html_strip_tags", f"select page_id, {_strip} as text from pages")(lambda spark, sf: table(spark, sf, "pages").select("page_id", X.strip_tags(F.col("html")).alias("text")))
tables(
    "injection_scan",
    "select doc_id, n as signs, case when n > 2 then 'HIGH' when n > 0 then 'MEDIUM' else 'NONE' end as risk from (select doc_id, "
    + " + ".join(f"cast(regexp_matches(lower(coalesce(text, '')), '{p}') as int)" for p in vocab.INJECTION)
    + " as n from documents)",
)(lambda spark, sf: table(spark, sf, "documents").select("doc_id", X.injection_signs(F.col("text")).alias("signs"), X.injection_risk(F.col("text")).alias("risk")))


@tables("retrieval_seeds", "select distinct p.p_partkey as query_id, s.id from part p, (select distinct p_type as id from part) s where list_has(string_split(p.p_name, ' '), lower(s.id))")
def _seeds(spark: SparkSession, sf: str) -> DataFrame:
    g = fixtures.build(spark, sf)
    return X.retrieval_seeds(g, table(spark, sf, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("text")))


_TURN_CLASS, _TURN_CONFIDENCE = "['country', 'Person', 'planet', 'relationship'][turn % 4 + 1]", "[0.9, 1.0, 0.4][conv_id % 3 + 1]::double"


@tables(
    "extract_validate",
    f"""select conv_id, turn, 0 as pos, {_TURN_CLASS} as class, stripped as text, {_TURN_CONFIDENCE} as confidence, cast(null as varchar) as parse_error
    from (select *, regexp_replace(text, '^[\\s\\x0b\\x85\\p{{Z}}]+|[\\s\\x0b\\x85\\p{{Z}}]+$', '', 'g') as stripped from conversations) where {_TURN_CLASS} in ('country', 'Person') and {_TURN_CONFIDENCE} >= 0.5 and stripped <> ''""",
)
def _extract(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as answers of a model: wrapped in JSON with classes and confidences by turn."""
    turns = table(spark, sf, "conversations")
    kind = F.element_at(F.array(*(F.lit(x) for x in ("country", "Person", "planet", "relationship"))), (F.col("turn") % 4 + 1).cast("int"))
    confidence = F.element_at(F.array(F.lit("0.9"), F.lit("1.7"), F.lit("0.4")), (F.col("conv_id") % 3 + 1).cast("int"))
    body = F.to_json(F.struct(F.array(F.struct(kind.alias("extraction_class"), F.col("text").alias("extraction_text"), F.create_map(F.lit("source"), F.lit("a")).alias("attributes"), confidence.alias("confidence"))).alias("extractions")))
    return parse_answers(turns.select("conv_id", "turn", F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```")).alias("answer"))).drop("attributes")


@tables("lexicon_extract")
def _lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """What a lexicon finds in all documents."""
    from weftgraph.functions.extract import extract

    run = lexicon_extractor({"The": "organization", "Und": "country", "Les": "person", "Que": "event"}, {"of": "part of", "und": "joins", " et": "meets"})
    return extract(table(spark, sf, "documents").select("doc_id", "text"), run).drop("attributes")


_hosts = ("127.1", "2130706433", "0x7f.0.0.1", "10.0.0.1", "[::1]", "localhost", "8.8.8.8", "134744072")
tables("url_validation", f"select page_id, case when page_id % 10 < 8 then page_id % 10 >= 6 else regexp_matches(lower(url), '^https?://[^/?#:]') end as allowed from pages")(lambda spark, sf: _urls(spark, sf))


def _urls(spark: SparkSession, sf: str) -> DataFrame:
    """Urls of pages; eight in ten have another host, six of these private ones in several spellings."""
    k = (F.col("page_id") % 10).cast("int")
    other = F.concat(F.lit("http://"), F.element_at(F.array(*(F.lit(h) for h in _hosts)), k + 1), F.lit("/x"))
    return table(spark, sf, "pages").select("page_id", D.url_allowed(F.when(k < len(_hosts), other).otherwise(F.col("url"))).alias("allowed"))


tables("request_limits", "select doc_id, length(trim(coalesce(text, ''))) > 0 and length(coalesce(text, '')) <= 2000 as ok from documents")(lambda spark, sf: table(spark, sf, "documents").select("doc_id", D.request_ok(F.coalesce("text", F.lit("")), 2000).alias("ok")))
tables("reference_lookup", "select o_orderkey::varchar as id, substr(text, 1, 300) as summary, case when doc_id is not null then 'doc:' || doc_id end as url from orders left join documents on doc_id = o_orderkey")(lambda spark, sf: _lookup(spark, sf))


def _lookup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("summary"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("url"))
    return D.lookup(table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id")), docs)


tables("unprocessed_pages", "select distinct url from pages where url not in (select url from pages where page_id % 3 = 0 and url is not null)")(
    lambda spark, sf: D.unprocessed(table(spark, sf, "pages").filter("url is not null"), table(spark, sf, "pages").filter("page_id % 3 = 0 and url is not null")).select("url")
)
tables("processed_registry", "select url, max(page_id) as ts from pages where url is not null group by url order by ts desc, url limit 40")(
    lambda spark, sf: D.remember(table(spark, sf, "pages").filter("page_id % 2 = 0 and url is not null").select("url", F.col("page_id").alias("ts")), table(spark, sf, "pages").filter("url is not null").select("url", F.col("page_id").alias("ts")), 40)
)
graph("sanctions_match", "select distinct v.id, n_name || ' Trading' as entry from v join nation on lower(v.id) = lower(n_name) union select 'Brand#11', 'Brand#11' where exists (select 1 from v where id = 'Brand#11')")(
    lambda g: D.sanctioned(g.v, g.v.filter("`group` = 'country'").select(F.concat("id", F.lit(" Trading")).alias("name")).unionByName(g.spark.createDataFrame([("Brand#11",)], "name string")))
)
tables("title_attributes", "select n_nationkey as k, n_name as role, case when n_nationkey % 2 = 0 then 'json' else 'literal' end as form from nation")(lambda spark, sf: _titles(spark, sf))


def _titles(spark: SparkSession, sf: str) -> DataFrame:
    """Titles that hold attributes as JSON, or as a literal with a tuple of which JSON knows nothing."""
    form = lambda text, q: F.concat(F.lit(f"{{{q}role{q}: {q}"), "n_name", F.lit(f"{q}, {q}form{q}: {text}}}"))
    title = F.when(F.col("n_nationkey") % 2 == 0, form('"json"', '"')).otherwise(form("'literal', 'x': (1, None)", "'"))
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), N.title_map(title).alias("m"))
    return rows.select("k", F.col("m")["role"].alias("role"), F.col("m")["form"].alias("form"))


tables("clean_output", "select c_name as id, case when c_mktsegment = 'BUILDING' then 'country' else 'unknown' end as grp, case when c_acctbal between 0 and 1 then c_acctbal else 0.5::double end as confidence from customer")(
    lambda spark, sf: X2.clean_output(
        table(spark, sf, "customer").select(F.col("c_name").alias("id"), F.when(F.col("c_mktsegment") == "BUILDING", "country").otherwise(F.col("c_mktsegment")).alias("group"), F.col("c_acctbal").alias("confidence"))
        .unionByName(spark.createDataFrame([("", "country", 0.5), ("x" * 101, "country", 0.5)], "id string, group string, confidence double"))
    ).withColumnRenamed("group", "grp")
)
tables("clean_relations", "select p_name as src, p_brand as dst, left(repeat(p_type || ' ', 5), 60) as label, case when p_size <= 1 then p_size::double else 0.5::double end as confidence from part")(
    lambda spark, sf: X2.clean_relations(table(spark, sf, "part").select(F.col("p_name").alias("src"), F.col("p_brand").alias("dst"), F.repeat(F.concat("p_type", F.lit(" ")), 5).alias("label"), F.col("p_size").cast("double").alias("confidence")).unionByName(spark.createDataFrame([("", "x", "l", 0.5), ("a", None, "l", 0.5)], "src string, dst string, label string, confidence double")))
)
tables("long_articles", "select doc_id from documents where length(trim(text)) >= 200")(lambda spark, sf: table(spark, sf, "documents").filter(D.long_enough(F.col("text"))).select("doc_id"))
tables("first_per_feed", "select source, doc_id, rn from (select source, doc_id, row_number() over (partition by source order by doc_id desc) as rn from documents) where rn <= 10")(
    lambda spark, sf: M.keep_newest_of_each(table(spark, sf, "documents"), "source", "doc_id", 10, "doc_id").select("source", "doc_id", F.col("rn").cast("bigint").alias("rn"))
)
tables("source_entity_bipartite", "select distinct regexp_extract(url, '://([^/?#]+)', 1) as source, page_id % 50 as id from pages")(lambda spark, sf: T.source_entities(table(spark, sf, "pages").select((F.col("page_id") % 50).alias("id"), "url")))

# -- vectors --------------------------------------------------------------------------------------

_dot = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1]::double * z[2]::double))".format
tables("cosine_topk", f"select vec_id, round({_dot('embedding', 'one')} / sqrt({_dot('embedding', 'embedding')} * {_dot('one', 'one')}), 6) as similarity from embeddings, (select embedding as one from embeddings where vec_id = 7) where vec_id <> 7 order by similarity desc, vec_id limit 8")(
    lambda spark, sf: V.cosine_topk(table(spark, sf, "embeddings"), "vec_id", "embedding", 7).select("vec_id", F.round("similarity", 6).alias("similarity"))
)
tables(
    "seed_mean_search",
    f"""with u as (select vec_id, list_transform(embedding, lambda x: x::double / sqrt({_dot("embedding", "embedding")})) as u from embeddings),
    m as (select list(x order by i) as mean from (select i, avg(x) as x from (select unnest(u) as x, generate_subscripts(u, 1) as i from u where vec_id % 100 = 3) group by i))
    select vec_id, round({_dot("u", "mean")} / sqrt({_dot("u", "u")} * {_dot("mean", "mean")}), 6) as similarity from u, m where vec_id % 100 <> 3 order by similarity desc, vec_id limit 8""",
)(lambda spark, sf: V.seed_search(table(spark, sf, "embeddings"), "vec_id", "embedding", table(spark, sf, "embeddings").filter("vec_id % 100 = 3")).select("vec_id", F.round("similarity", 6).alias("similarity")))
tables("unit_vectors", f"select vec_id, round({_dot('embedding', 'embedding')}, 4) as square, round(list_sum(list_transform(embedding, lambda x: (x::double / sqrt({_dot('embedding', 'embedding')})) ** 2)), 4) as unit_square from embeddings")(
    lambda spark, sf: table(spark, sf, "embeddings").select("vec_id", F.round(V.dot(F.col("embedding"), F.col("embedding")), 4).alias("square"), F.round(V.dot(V.unit(F.col("embedding")), V.unit(F.col("embedding"))), 4).alias("unit_square"))
)
tables(
    "text_seed_search",
    f"""with u as (select vec_id, list_transform(embedding, lambda x: x::double / sqrt({_dot("embedding", "embedding")})) as u from embeddings),
    m as (select list(x order by i) as mean from (select i, avg(x) as x from (select unnest(u) as x, generate_subscripts(u, 1) as i from u where contains(vec_id::varchar, '77')) group by i))
    select vec_id::varchar as id, round({_dot("u", "mean")} / sqrt({_dot("u", "u")} * {_dot("mean", "mean")}), 6) as similarity from u, m where not contains(vec_id::varchar, '77') order by similarity desc, vec_id::varchar limit 8""",
)(lambda spark, sf: V.text_search(table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding"), "id", "embedding", "77").select("id", F.round("similarity", 6).alias("similarity")))


@tables("embedding_store", f"select vec_id::varchar as id, len(embedding)::int as dim, round(embedding[1]::double / sqrt({_dot('embedding', 'embedding')}), 4) as first, round(list_sum(list_transform(embedding, lambda x: x::double / sqrt({_dot('embedding', 'embedding')}))), 4) as total from embeddings")
def _embedding_store(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors written and read again, of length 1."""
    path = new_path(spark, "embeddings")
    V.save_embeddings(table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector")), path)
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)
    return V.load_embeddings(spark, path).select("id", F.size("vector").alias("dim"), F.round(F.col("vector")[0], 4).alias("first"), F.round(total, 4).alias("total"))


tables("kmeans_clusters")(lambda spark, sf: V.kmeans(table(spark, sf, "embeddings"), "vec_id", "embedding", 6))
graph("node_embeddings")(lambda g: V.node_embeddings(g.staged()))

# -- events and history ---------------------------------------------------------------------------

tables("rate_limit_violations", "select event_id, user_id, seen from (select event_id, user_id, count(*) over (partition by user_id order by ts range between interval 3600 seconds preceding and current row) as seen from events) where seen > 2")(
    lambda spark, sf: W.rate_violations(table(spark, sf, "events"), "user_id", 2, 3600).select("event_id", "user_id", "seen")
)
tables("retention_newest_n", "select event_id, ts from events order by ts desc, event_id desc limit 50")(lambda spark, sf: M.keep_newest(table(spark, sf, "events").select("event_id", "ts"), "ts", 50, "event_id"))
tables(
    "session_activity",
    """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as fresh from events),
    s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts) as k from g)
    select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as events from s group by user_id, k""",
)(lambda spark, sf: W.sessions(table(spark, sf, "events"), "user_id").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events"))
tables("windowed_counts", "select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n from events group by all")(
    lambda spark, sf: W.windowed_counts(table(spark, sf, "events"), "event_type").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")
)
tables("alert_rises", "select event_id, user_id from (select *, value >= 100 as over_, coalesce(lag(value >= 100) over (partition by user_id order by ts), false) as before from events) where over_ and not before")(
    lambda spark, sf: W.alerts(table(spark, sf, "events").select(F.col("user_id").alias("id"), "ts", F.col("value").alias("score"), F.lit(100.0).alias("threshold"), "event_id")).select("event_id", F.col("id").alias("user_id"))
)
tables("snapshot_debounce", "select event_id from (select event_id, ts - lag(ts) over (partition by event_type order by ts) as gap from events) where gap is null or gap >= interval 300 seconds")(
    lambda spark, sf: W.debounced(table(spark, sf, "events"), "event_type", 300).select("event_id")
)
tables("entity_lifecycle", "select user_id as id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_seen, count(*) as mentions, date_diff('day', max(ts)::date, date '2024-03-01') > 30 as dormant from events group by user_id")(
    lambda spark, sf: T.lifecycle(table(spark, sf, "events").select(F.col("user_id").alias("id"), "ts"), F.lit("2024-03-01").cast("date")).select("id", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_seen", "last_seen")), "mentions", "dormant")
)
tables("influence_trajectory", "select id, n, round(slope, 6) as slope, case when slope > 0.02 then 'rising' when slope < -0.02 then 'falling' else 'stable' end as trend from (select user_id as id, count(*) as n, (arg_max(value, ts) - arg_min(value, ts)) / greatest(count(*) - 1, 1) as slope from events group by user_id) where n >= 3")(
    lambda spark, sf: T.trajectory(table(spark, sf, "events").select(F.col("user_id").alias("id"), "ts", "value"))
)
tables("source_reliability", "select event_type as domain, round(greatest(0.0, least(1.0, (count(*) filter (value > 80) - count(*) filter (value < 10) * 2) / count(*)::double + 0.5)), 6) as score from events group by event_type")(
    lambda spark, sf: table(spark, sf, "events").groupBy(F.col("event_type").alias("domain")).agg(F.round(T.source_reliability(F.count(F.lit(1)), F.count_if(F.col("value") > 80), F.count_if(F.col("value") < 10)), 6).alias("score"))
)
tables("feed_totals", "select event_type as feed, count(*) filter (user_id % 3 = 0) as ok, count(*) filter (user_id % 3 = 1) as skipped, count(*) filter (user_id % 3 = 2) as errors, cast(sum(event_id % 7) as bigint) as entities, cast(sum(event_id % 5) as bigint) as relations from events group by event_type")(
    lambda spark, sf: _feed_totals(spark, sf)
)


def _feed_totals(spark: SparkSession, sf: str) -> DataFrame:
    from weftgraph.streaming.ingest import feed_totals

    status = F.element_at(F.array(F.lit("ok"), F.lit("skipped"), F.lit("error")), (F.col("user_id") % 3 + 1).cast("int"))
    return feed_totals(table(spark, sf, "events").select(F.col("event_type").alias("feed"), status.alias("status"), (F.col("event_id") % 7).alias("entities"), (F.col("event_id") % 5).alias("relations")))


_decay = "greatest(0.1, round(o_totalprice / 600000 * exp(-0.1 / ln(1 + greatest(o_orderkey % 4, 1)) * date_diff('day', o_orderdate::date, date '1999-01-01') / 30.0), 3))"
tables("edge_decay", f"select o_orderkey, {_decay} as confidence, {_decay} < 0.4 as is_stale from orders")(lambda spark, sf: _edge_decay(spark, sf))


def _edge_decay(spark: SparkSession, sf: str) -> DataFrame:
    days = F.datediff(F.lit("1999-01-01").cast("date"), F.col("o_orderdate"))
    c = T.decayed(F.col("o_totalprice") / 600000, days, F.col("o_orderkey") % 4)
    return table(spark, sf, "orders").select("o_orderkey", c.alias("confidence"), T.stale(c).alias("is_stale"))


tables("stale_edges", "select o_orderkey, date_diff('day', o_orderdate::date, date '1999-01-01') as staleness_days, date_diff('day', o_orderdate::date, date '1999-01-01') > 60 as is_stale from orders")(
    lambda spark, sf: T.staleness(table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("last_confirmed"), F.col("o_orderdate").alias("first_seen")), F.lit("1999-01-01").cast("date")).select("o_orderkey", F.col("staleness_days").cast("bigint").alias("staleness_days"), "is_stale")
)
_SESSIONS = "ses as (select distinct l_orderkey as session, n_name as id from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey), co as (select a.id as a, b.id as b, count(*) as n from ses a join ses b on a.session = b.session and a.id < b.id group by 1, 2)"


def _cooccurrence(spark: SparkSession, sf: str) -> DataFrame:
    return T.cooccurrence(fixtures.sql(spark, sf, "select l_orderkey as session, n_name as id from {lineitem} join {supplier} on l_suppkey = s_suppkey join {nation} on s_nationkey = n_nationkey"))


tables("cooccurrence", f"with {_SESSIONS} select a, b, n from co")(_cooccurrence)
tables("missing_edges", f"with {fixtures.CTES}, {_SESSIONS} select a, b, n from co where n >= 5 and not exists (select 1 from e where (src = a and dst = b) or (src = b and dst = a))")(lambda spark, sf: T.missing_edges(_cooccurrence(spark, sf), fixtures.build(spark, sf).e))
_credible = "least(1.0, least(1.0, 0.5 + len(d) * 0.15) + coalesce(list_sum(list_transform(d, lambda x: case x " + " ".join(f"when '{k}' then {q}" for k, q in vocab.SOURCE_QUALITY.items()) + " else 0 end)), 0) / 10)"
_domains = list(vocab.SOURCE_QUALITY) + ["example.org"]
tables("edge_credibility", f"select o_orderkey, round({_credible}, 6) as credibility from (select o_orderkey, list_slice({_domains}, 1 + o_orderkey % 3, 2 + o_orderkey % 5) as d from orders)")(lambda spark, sf: _credibility(spark, sf))


def _credibility(spark: SparkSession, sf: str) -> DataFrame:
    first, last = F.col("o_orderkey") % 3 + 1, F.col("o_orderkey") % 5 + 2
    d = F.slice(F.array(*(F.lit(x) for x in _domains)), first.cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", F.round(T.edge_credibility(d), 6).alias("credibility"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
