"""Golden micro-graphs for the graph operators."""

import math
import random

import pytest

from weftgraph import fixtures
from weftgraph.graph import Graph
from weftgraph.operators import analytics as A
from weftgraph.operators import mutate as M
from weftgraph.operators import paths as P
from weftgraph.operators import trees
from weftgraph.operators import relational as R
from weftgraph.operators import vectors as V
from weftgraph.operators.components import components
from weftgraph.plans import gql


def g(spark, edges, vertices=None, group="country"):
    ids = dict.fromkeys(x for e in edges for x in e[:2]) if vertices is None else vertices
    return Graph.literal(spark, [(v, group) if isinstance(v, str) else v for v in ids], edges)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_tension_of_two_countries(spark):
    graph = g(spark, [("Russia", "Ukraine", "invades")])
    raw = {r.id: round(r.raw, 3) for r in A.raw_tension(graph).collect()}
    assert raw == {"Russia": 22.464, "Ukraine": 16.848}
    got = {r.id: (round(r.score, 6), r.alert) for r in A.country_tension(graph).collect()}
    assert got == {"Russia": (100.0, True), "Ukraine": (75.0, True)}
    high = spark.createDataFrame([("Ukraine", 80.0)], "id string, threshold double")
    assert {r.id for r in A.country_tension(graph, high).filter("alert").collect()} == {"Russia"}


def test_tension_counts_military_events_and_gazetteer_names(spark):
    graph = Graph.literal(spark, [("France", None), ("battle of x", "event"), ("fair", "event"), ("y", "person")], [("France", "battle of x", "hosts"), ("fair", "France", "near"), ("y", "France", "in")])
    (r,) = A.raw_tension(graph).collect()
    assert r.id == "France" and r.raw == pytest.approx((2 * 1.2 + 7 + 2 * 0.9 * 2) * (1 + 0.04 * 3))


def test_conflicts_and_reciprocal(spark):
    graph = g(spark, [("A", "B", "supports"), ("B", "A", "bombs"), ("C", "D", "ally"), ("D", "C", "trade"), ("E", "F", "sanctions"), ("F", "E", "threatens"), ("X", "X", "attacks")])
    assert rows(A.conflicts(graph)) == [("A", "B", "supports", "bombs")]
    assert rows(A.reciprocal_hostility(graph)) == [("E", "F", "sanctions", "threatens"), ("X", "X", "attacks", "attacks")]


def test_triangles(spark):
    h = "attacks"
    assert rows(A.conflict_triangles(g(spark, [("A", "B", h), ("B", "C", h), ("A", "C", h)]))) == [("A", "B", "C")]
    assert rows(A.conflict_triangles(g(spark, [("A", "B", h), ("B", "C", h), ("C", "A", h)]))) == [("A", "B", "C")]
    # where A to C exists it must be the hostile one; the other rotations do not close
    assert rows(A.conflict_triangles(g(spark, [("A", "B", h), ("B", "C", h), ("A", "C", "visits")]))) == []
    assert rows(A.unstable_triangles(g(spark, [("A", "B", h), ("C", "B", h), ("C", "A", "trade")]))) == [("A", "B", "C")]
    assert rows(A.unstable_triangles(g(spark, [("A", "B", h), ("C", "B", h), ("C", "A", h)]))) == []


def test_risk_and_empty_graph(spark):
    empty = Graph.empty(spark)
    assert rows(A.global_risk(empty)) == [(0.0, "LOW", 0.0, 0, 0)]
    assert rows(A.totals(empty)) == [(0, 0, 0.0)]
    assert A.health(empty).first().score == 0
    assert rows(A.country_tension(empty)) == [] and rows(R.degree(empty)) == [] and rows(P.wcc(empty)) == [] and P.wcc_count(empty).first()[0] == 0
    h = "attacks"
    r = A.global_risk(g(spark, [("A", "B", h), ("B", "A", h)])).first()
    assert (r.risk, r.label, r.n_reciprocal) == (48.0, "MEDIUM", 1)


def test_health_with_eight_groups_is_over_100(spark):
    kinds = ["country", "person", "organization", "technology", "event", "treaty", "resource", "unknown"]
    edges = [(f"n{i}", f"n{(i + d) % 8}", f"l{i}-{d}") for i in range(8) for d in (1, 2, 3)]
    assert A.health(Graph.literal(spark, [(f"n{i}", k) for i, k in enumerate(kinds)], edges)).first().score == 105


def test_selfloop_degree_and_isolation(spark):
    graph = g(spark, [("X", "X", "l")], ["X", "Y"])
    assert {r.id: r.degree for r in R.degree(graph).collect()} == {"X": 2, "Y": 0}
    assert [r.id for r in R.isolated(graph).collect()] == ["Y"]


def test_path_falls_back_to_both_directions(spark):
    graph = g(spark, [("A", "B", "x"), ("C", "B", "y")])
    steps = P.shortest_path(graph, "A", "C")
    assert rows(steps.select("position", "src", "dst", "label", "reversed", "directed")) == [(0, "A", "B", "x", False, False), (1, "B", "C", "y", True, False)]
    r = P.path_summary(steps, "A", "C").first()
    assert (r.path, r.length, r.directed) == ("A>B>C", 2, False) and r.narrative == "A → [x] → B → [y] → C  (2 hops, undirected)"
    assert P.path_summary(P.shortest_path(graph, "A", "missing"), "A", "missing").collect() == []


def test_path_of_more_than_fifty_steps_is_directed(spark):
    chain = [(f"n{i:02}", f"n{i + 1:02}", "l") for i in range(51)]
    r = P.path_summary(P.shortest_path(g(spark, [*chain, ("n51", "x", "l"), ("x", "n00", "l")]), "n00", "n51"), "n00", "n51").first()
    assert (r.length, r.directed) == (51, True)


def random_edges(seed, n=9, m=16):
    r = random.Random(seed)
    return sorted({(f"v{r.randrange(n)}", f"v{r.randrange(n)}") for _ in range(m)}), [f"v{i}" for i in range(n)]


def brute_betweenness(edges, ids):
    out = dict.fromkeys(ids, 0.0)
    nxt = {v: {b for a, b in edges if a == v and b != v} for v in ids}
    for s in ids:
        level, dist = [[s]], {s: 0}
        paths = {s: [[s]]}
        while level[-1]:
            front = {}
            for v in level[-1]:
                for w in nxt[v]:
                    if w not in dist:
                        front.setdefault(w, []).extend(p + [w] for p in paths[v])
            for w in front:
                dist[w] = len(level)
            paths |= front
            level.append(list(front))
        for t, ps in paths.items():
            for p in ps if t != s else []:
                for v in p[1:-1]:
                    out[v] += 1 / len(ps)
    n = len(ids)
    return {v: x / ((n - 1) * (n - 2)) for v, x in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_betweenness_by_brute_force(spark, seed):
    edges, ids = random_edges(seed)
    got = {r.id: r.betweenness for r in P.betweenness(g(spark, [(*e, "l") for e in edges], ids)).collect()}
    assert got == pytest.approx(brute_betweenness(edges, ids))


def test_betweenness_guard(spark):
    assert P.top_betweenness(g(spark, [("A", "B", "l"), ("B", "C", "l")]), 5).collect() == []


@pytest.mark.parametrize("seed", [3])
def test_components_and_bridges_by_brute_force(spark, seed):
    edges, ids = random_edges(seed, 14, 14)

    def parts(es):
        up = {v: v for v in ids}

        def root(v):
            while up[v] != v:
                v = up[v]
            return v

        for a, b in es:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
        return {v: root(v) for v in ids}

    graph = g(spark, [(*e, "l") for e in edges], ids)
    assert {r.id: r.component for r in P.wcc(graph).collect()} == parts(edges)
    und = sorted({tuple(sorted(e)) for e in edges if e[0] != e[1]})
    want = [e for e in und if len(set(parts([x for x in und if x != e]).values())) > len(set(parts(und).values()))]
    assert rows(trees.bridges(graph)) == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r.id: r.root for r in components(edges).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_ego_and_simple_paths(spark):
    graph = g(spark, [("A", "B", "l"), ("B", "C", "l"), ("C", "D", "l"), ("A", "C", "l"), ("D", "E", "l")])
    assert rows(P.ego(graph, "A", 1).v.select("id")) == [("A",), ("B",), ("C",)]
    assert P.ego(graph, "missing").v.count() == 5
    assert [tuple(r) for r in P.all_simple_paths(graph, "A", "D").collect()] == [("A>C>D", 2), ("A>B>C>D", 3)]


def test_merge(spark):
    graph = g(spark, [("S", "T", "a"), ("S", "X", "from source", 0.1), ("T", "X", "from target", 0.9), ("Y", "S", "b")])
    merged = M.merge(graph, "S", "T")
    assert rows(merged.e.select("src", "dst", "label", "weight")) == [("T", "X", "from target", 2.0), ("Y", "T", "b", None)]
    assert rows(merged.v.select("id")) == [("T",), ("X",), ("Y",)]
    assert rows(M.merge(graph, "S", "new").v.select("id")) == [("T",), ("X",), ("Y",), ("new",)]


def test_resolution(spark):
    v = g(spark, [], ["Iran", "Nigeria", "Australia", "Russian", "South Korea", "US"]).v
    names = spark.createDataFrame([(x,) for x in ("Irann", "Niger", "Austria", "Russia", "North Korea", "Iraq", "United States", "iran", "USA")], "name string")
    got = {r.name: r.id for r in M.resolve(names, v).collect()}
    assert got == {"Irann": "Iran", "Niger": "Nigeria", "Austria": "Australia", "Russia": "Russian", "North Korea": None, "Iraq": None, "United States": None, "iran": "Iran", "USA": None}
    alias = spark.createDataFrame([("usa", "US"), ("united states", "US")], "alias string, id string")
    assert {r.name: r.id for r in M.resolve(names, v, aliases=alias).collect() if r.id == "US"} == {"USA": "US", "United States": "US"}


def test_upsert(spark):
    schema = "class string, text string, attributes map<string,string>, confidence double, pos bigint"
    x = [("country", "Iran", {"k": "1"}, 0.6, 0), ("country", "Irann", {"k": "2"}, 0.9, 1), ("person", "Ann Example", {}, 0.8, 2), ("relationship", "visits", {"source": "ann example", "target": "Stubland"}, 0.7, 3), ("relationship", "leaves", {"source": "Ann Example", "target": "Stubland"}, 0.6, 4)]
    old = Graph.literal(spark, [("Ann Example", "unknown", 0.9)], [("Ann Example", "Stubland", "old")])
    change = M.upsert(old, spark.createDataFrame(x, schema))
    got = {r.id: (r.group, r.confidence) for r in change.graph.v.collect()}
    assert got == {"Iran": ("country", 0.9), "Ann Example": ("person", 0.9), "Stubland": ("unknown", None)}
    assert rows(change.graph.e.select("src", "dst", "label")) == [("Ann Example", "Stubland", "leaves")]
    assert rows(change.nodes_added) == [("Iran",)] and rows(change.edges_added) == []


def test_diff_of_a_graph_with_itself_is_empty(spark, sf_dir):
    graph = fixtures.build(spark, sf_dir)
    assert M.diff(graph, graph).collect() == []


def test_plural_groups(spark):
    graph = Graph.literal(spark, [("a", "country"), ("b", "technology"), ("c", "person")], [])
    assert [len(R.find_nodes(graph, x).collect()) for x in ("countries", "technologies", "persons", "country")] == [1, 1, 1, 1]
    assert [len(R.find_nodes(graph, x, literal=True).collect()) for x in ("countries", "technologies", "persons")] == [0, 0, 1]


def test_query_language(spark):
    graph = g(spark, [("Iran", "Iraq", "sanctions firms", 0.9), ("Iraq", "Peru", "trade", 0.4)], [("Iran", "country"), ("Iraq", "country"), ("Peru", "country"), ("Lone", "person")])
    ids = lambda q: [r[0] for r in gql.run(graph, q).collect()]
    assert ids("find   COUNTRIES") == ["Iran", "Iraq", "Peru"]
    assert ids("find countries that sanctions iraq") == ["Iran"]
    assert ids("isolated nodes") == ["Lone"]
    assert [tuple(r)[:3] for r in gql.run(graph, "list edges where label contains Sanctions").collect()] == [("Iran", "Iraq", "sanctions firms")]
    assert gql.run(graph, "path from iran to peru").first().path == "Iran>Iraq>Peru"
    assert gql.run(graph, "count relationships between iran and iraq").first().n == 1
    assert ids("ego of iran hops 1") == ["Iran", "Iraq"]
    assert ids("top 1 node by degree") == ["Iraq"]
    assert gql.answer(graph, "what is this").kind == "error" and gql.answer(graph, "neighbors of nobody at all").kind == "error"
    assert gql.answer(graph, "edges between nobody and nothing").rows == []
    assert gql.answer(graph, "nodes with confidence >= 1.2.3").kind == "error"
    assert gql.answer(graph, "help").count == len(gql.HELP)
    assert gql.auto_queries(graph, 0)[0] == "neighbors of Iraq"


def test_cap_tells_of_more(spark):
    graph = Graph.literal(spark, [(f"p{i:03}", "person") for i in range(230)], [])
    a = gql.answer(graph, "find persons")
    assert (len(a.rows), a.count, a.truncated) == (200, 230, True)


def test_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0])], "id int, v array<float>")
    assert [(r.id, round(r.similarity, 4)) for r in V.cosine_topk(df, "id", "v", 0).collect()] == [(1, round(math.sqrt(0.5), 4)), (2, 0.0)]
    assert V.cosine_topk(df, "id", "v", 3).collect() == []
    assert [r.id for r in V.seed_search(df, "id", "v", df.filter("id in (0, 2)")).collect()] == [1]


def test_walks_follow_edges(spark):
    graph = g(spark, [("A", "B", "l"), ("B", "C", "l"), ("C", "A", "l"), ("C", "D", "l")])
    arcs = {("A", "B"), ("B", "C"), ("C", "A"), ("C", "D")}
    arcs |= {(b, a) for a, b in arcs}
    paths = [r.path for r in V.walks(graph, 3, 6).collect()]
    assert len(paths) == 12 and all(len(p) == 6 and all(s in arcs for s in zip(p, p[1:])) for p in paths)
    assert sorted(paths) == sorted(r.path for r in V.walks(graph, 3, 6).collect())


def test_sample_prefers_hubs(spark):
    graph = g(spark, [("H", f"x{i}", "l") for i in range(4)] + [("y", "z", "l")])
    got = R.edge_sample(graph, 5, 1).collect()
    assert [r.hub for r in got] == [True] * 4 + [False] and got[4].line == "y -[l]-> z"


def test_filters_reach_the_scan(spark, sf_dir):
    plan = R.capped(R.find_nodes(fixtures.build(spark, sf_dir), "country"))._jdf.queryExecution().executedPlan().toString()
    assert "o_orderkey" not in plan


def test_capped_rules_tell_how_many_match(spark):
    """300 matches: 200 rows, a count of 300, and truncated."""
    e = [("Hub", f"N{i:03}", "sends aid to") for i in range(300)] + [(f"N{i:03}", f"N{(i + 1) % 300:03}", "knows") for i in range(300)]
    graph = g(spark, e, [("Hub", "country"), *((f"N{i:03}", "person") for i in range(300))]).staged()
    for text in ("edges where label contains aid", "neighbors of hub", "nodes with degree >= 3", "nodes with degree>=3", "successors of Hub", "find persons", "hub nodes with degree 3", "nodes with confidence >= 0.5", "ego of hub hops 1"):
        a = gql.answer(graph, text)
        if text == "nodes with degree>=3":
            assert a.kind == "error"
        else:
            assert (len(a.rows), a.truncated) == (200, True) and a.count in (300, 301), text
    assert gql.answer(graph, "nodes with degree >300").count == 0 and gql.answer(graph, "edges between hub and n000").truncated is False


def test_paths_of_any_length(spark):
    e = [(f"N{i:03}", f"N{i + 1:03}", "l") for i in range(12)]
    graph = g(spark, e)
    assert P.path_summary(P.shortest_path(graph, "N000", "N012"), "N000", "N012").select("length", "directed").first() == (12, True)
    assert P.path_summary(P.shortest_path(graph, "N012", "N000"), "N012", "N000").select("length", "directed").first() == (12, False)


def test_forms_of_the_language():
    say = lambda t: (lambda q: (q.kind, q.params))(gql.parse(t))
    assert say("Show PATH from  A to b to C") == ("path", {"a": "a", "b": "b to c"})
    assert say("path from 'new york' to \"Rome\"") == ("path", {"a": "new york", "b": "rome"})
    assert say("incoming of x")[0] == "predecessors" and say("neighbours of x y") == ("neighbors", {"a": "x y"})
    assert say("ego of a b hops 3") == ("ego", {"a": "a b", "n": "3"}) and say("ego of hops") == ("ego", {"a": "hops"})
    assert say("node with degree >=5") == say("nodes with degree >= 5 please") == ("degree", {"op": ">=", "n": "5"})
    assert say("nodes with confidence < .5") == ("confidence", {"op": "<", "n": ".5"})
    assert say("list edges from a to b") == ("edges_between", {"a": "a", "b": "b"})
    assert say("edges with label trade deal") == ("edges_label", {"text": "trade deal"}) and say("edge label contains") == ("edges_label", {"text": "contains"})
    assert say("count edges between a and b")[0] == "count_between" and say("count edges") == ("count", {"group": "edges"})
    assert say("find people that trade with x") == ("find_that", {"group": "people", "verb": "trade", "a": "with x"}) and say("find people") == ("find", {"group": "people"})
    assert say("orphan nodes")[0] == "isolated" and say("hub nodes with degree 4") == ("hubs", {"n": "4"}) and say("?")[0] == "help"
    for bad in ("", "nodes", "path from a", "top x nodes by degree", "nodes with degree 5", "help me"):
        with pytest.raises(gql.QueryError):
            gql.parse(bad)
