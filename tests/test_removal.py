"""Removal of vertices, searches from both ends, embeddings and clusters against plain models."""

import itertools
import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.operators import paths as P
from weftgraph.operators import vectors as V


def graph(spark, edges, ids, group="country"):
    return Graph.literal(spark, [(v, group) for v in ids], [(*e, "l") for e in edges])


def random_graph(seed, n=12, m=26):
    r = random.Random(seed)
    ids = [f"v{i:02}" for i in range(n)]
    return sorted({(a, b) for a, b in ((r.choice(ids), r.choice(ids)) for _ in range(m)) if a != b}), ids


def shortest(edges, s, t):
    """All shortest paths, each a list."""
    level, out = [[s]], []
    seen = {s}
    while level and not out:
        nxt = []
        for p in level:
            for a, b in edges:
                if a == p[-1] and b not in seen:
                    nxt.append([*p, b])
        seen |= {p[-1] for p in nxt}
        out = [p for p in nxt if p[-1] == t]
        level = nxt
    return out


def between(edges, ids):
    out = dict.fromkeys(ids, 0.0)
    for s, t in itertools.permutations(ids, 2):
        ps = shortest(edges, s, t)
        for p in ps:
            for v in p[1:-1]:
                out[v] += 1 / len(ps)
    n = len(ids)
    return {v: x / ((n - 1) * (n - 2)) for v, x in out.items()}


@pytest.mark.parametrize("seed", [1])
def test_removal_by_brute_force(spark, seed):
    edges, ids = random_graph(seed, 10, 18)
    g = graph(spark, edges, ids)
    rest = [e for e in edges if "v03" not in e]
    old, new = between(edges, ids), between(rest, [v for v in ids if v != "v03"])
    got = {r.id: (r.before, r.after, r.delta) for r in P.centrality_shift(g, "v03").collect()}
    assert got.keys() == new.keys()
    for v, x in got.items():
        assert x == pytest.approx((old[v], new[v], new[v] - old[v]), abs=1e-12)
    row = P.removal_effect(g, "v03").first()
    top = sorted(new, key=lambda v: (-abs(new[v] - old[v]), v))[:10]
    gains = sorted((v for v in top if new[v] - old[v] > 1e-12), key=lambda v: (-(new[v] - old[v]), v))[:5]
    assert [round(x["delta"], 9) for x in row.winners] == [round(new[v] - old[v], 9) for v in gains]
    linked = lambda es: {v for e in es for v in e}
    assert sorted(r.id for r in P.orphaned(g, "v03").collect()) == sorted(linked(edges) - linked(rest) - {"v03"}) and row.orphans == len(linked(edges) - linked(rest) - {"v03"})


def test_betweenness_in_batches_is_the_same(spark):
    edges, ids = random_graph(5, 10, 22)
    g = graph(spark, edges, ids)
    whole, parts = ({r.id: round(r.betweenness, 10) for r in P.betweenness(g, most).collect()} for most in (4096, 5))
    assert whole == parts == {v: round(x, 10) for v, x in between(edges, ids).items()}


@pytest.mark.parametrize("seed, most", [(1, 100_000), (2, 0)])
def test_paths_from_both_ends(spark, monkeypatch, seed, most):
    monkeypatch.setattr(P, "FOLLOWING", most)
    edges, ids = random_graph(seed, 16, 24)
    g = graph(spark, edges, ids)
    r = random.Random(seed)
    both = sorted({*edges, *((b, a) for a, b in edges)})
    for s, t in [r.sample(ids, 2) for _ in range(3)]:
        found, directed = shortest(edges, s, t), True
        if not found:
            found, directed = shortest(both, s, t), False
        got = P.path_summary(P.shortest_path(g, s, t), s, t).collect()
        assert [(x.path, x.directed) for x in got] == [(">".join(min(found)), directed)] if found else got == []


def test_a_long_path(spark):
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(30)] + [("n000", "x"), ("x", "y"), ("y", "n029")]
    steps = P.shortest_path(graph(spark, edges, sorted({v for e in edges for v in e})), "n000", "n030").collect()
    assert [r.dst for r in sorted(steps, key=lambda r: r.position)] == ["x", "y", "n029", "n030"]


def test_embeddings_keep_planted_cliques_together(spark):
    """Three cliques with one edge between neighbours: a vertex's nearest are its clique's; several tasks train."""
    edges = [(f"c{c}_{i}", f"c{c}_{j}") for c in range(3) for i in range(7) for j in range(i)] + [(f"c{c}_0", f"c{c + 1}_0") for c in range(2)]
    ids = sorted({v for e in edges for v in e})
    got = {r.id: np.array(r.vector) for r in V.node_embeddings(graph(spark, edges, [*ids, "alone"]), dim=16, per_node=20, length=10, window=4).collect()}
    assert sorted(got) == ids and all(abs(np.linalg.norm(x) - 1) < 1e-6 and len(x) == 16 for x in got.values())
    for v in ids:
        near = sorted((u for u in ids if u != v), key=lambda u: -got[u] @ got[v])[:6]
        assert sum(u[:2] == v[:2] for u in near) >= 5, v
    assert V.node_embeddings(graph(spark, edges[:2], ids[:3])).collect() == []
    again = {r.id: np.array(r.vector) for r in V.node_embeddings(graph(spark, edges, [*ids, "alone"]), dim=16, per_node=20, length=10, window=4).collect()}
    assert all(np.allclose(again[v], got[v], atol=1e-4) for v in ids)


def test_co_visits_by_a_plain_loop(spark):
    r = random.Random(4)
    walks = [[r.choice("abcd") for _ in range(r.randrange(1, 9))] for _ in range(30)]
    got = {(x.x, x.y): x.n for x in V.co_visits(spark.createDataFrame([(w,) for w in walks], "path array<string>"), 3).collect()}
    want: dict = {}
    for w in walks:
        for i, j in itertools.combinations(range(len(w)), 2):
            if j - i <= 3 and w[i] != w[j]:
                for k in ((w[i], w[j]), (w[j], w[i])):
                    want[k] = want.get(k, 0) + 1
    assert got == want


def test_clusters_take_the_best_of_several_starts(spark):
    r = np.random.default_rng(1)
    centres = np.eye(6)
    rows = [(i * 6 + c, (centres[c] + r.normal(0, 0.05, 6)).tolist()) for i in range(20) for c in range(6)]
    got = {x.id: x.cluster for x in V.kmeans(spark.createDataFrame(rows, "id bigint, v array<double>"), "id", "v", 6).collect()}
    assert len(set(got.values())) == 6 and all(got[i] == got[i % 6] for i, _ in rows)
