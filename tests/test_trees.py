"""Forests, tours and bridges against plain searches."""

import random

import pytest

from weftgraph.graph import Graph
from weftgraph.operators import trees


def parts(ids, edges):
    up = {v: v for v in ids}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {v: root(v) for v in ids}


def random_edges(seed, n, m):
    r = random.Random(seed)
    return [(f"v{r.randrange(n):02}", f"v{r.randrange(n):02}") for _ in range(m)]


def bridges_by_removal(edges):
    ids = {v for e in edges for v in e}
    und = sorted({tuple(sorted(e)) for e in edges if e[0] != e[1]})
    whole = len(set(parts(ids, und).values()))
    return [e for e in und if len(set(parts(ids, [x for x in und if x != e]).values())) > whole]


def graph(spark, edges):
    return Graph.literal(spark, [(v, "x") for v in sorted({v for e in edges for v in e})], [(*e, "l") for e in dict.fromkeys(edges)])


@pytest.mark.parametrize("seed", [1])
def test_forest_and_tour(spark, seed):
    edges = random_edges(seed, 30, 32)
    tree, roots = trees.spanning_forest(spark.createDataFrame(edges, "a string, b string"))
    kept = [tuple(r) for r in tree.collect()]
    und = {tuple(sorted(e)) for e in edges if e[0] != e[1]}
    ids = {v for e in und for v in e}
    want = parts(ids, und)
    assert {r.id: r.root for r in roots.collect()} == want and set(kept) <= und and len(kept) == len(ids) - len(set(want.values()))
    by_root = {}
    for r in trees.euler_tour(tree, roots).collect():
        by_root.setdefault(r.root, []).append((r.after, r.x, r.y))
    for root, steps in by_root.items():
        steps.sort(reverse=True)
        assert [s[0] for s in steps] == list(range(len(steps) - 1, -1, -1)) and steps[0][1] == steps[-1][2] == root
        assert all(a[2] == b[1] for a, b in zip(steps, steps[1:]))


@pytest.mark.parametrize("seed, n, m", [(3, 14, 14), (4, 30, 34)])
def test_bridges_by_removal(spark, seed, n, m):
    edges = random_edges(seed, n, m)
    g = graph(spark, edges)
    want = bridges_by_removal(edges)
    assert sorted((r.a, r.b) for r in trees.bridges(g).collect()) == want
    told = {(r.a, r.b): (r.label, r.components) for r in trees.critical_edges(g).collect()}
    ids = {v for e in edges for v in e}
    assert told == {e: ("l", len(set(parts(ids, edges).values())) + 1) for e in want}


def test_bridges_of_nothing(spark):
    assert trees.bridges(Graph.literal(spark, [("a", "x")], [("a", "a", "l")])).collect() == []


@pytest.mark.parametrize("shuffled", [True])
def test_a_long_chain_takes_few_rounds(spark, monkeypatch, shuffled):
    """10,000 vertices in a row, with one cycle at its end: under 40 rounds of pointer jumps."""
    n, rounds = 10_000, []
    ids = list(range(n))
    if shuffled:
        random.Random(1).shuffle(ids)
    name = lambda i: f"v{ids[i]:05}"
    real = trees.stage
    monkeypatch.setattr(trees, "stage", lambda df, what: (rounds.append(what), real(df, what))[1])
    e = spark.createDataFrame([(name(i), name(i + 1), "l") for i in range(n - 1)] + [(name(n - 1), name(n - 3), "l")], "src string, dst string, label string")
    got = trees.bridges(Graph.of(spark.createDataFrame([(name(i),) for i in ids], "id string"), e))
    assert got.count() == n - 3
    assert sum(what in ("forest-jumps", "tour-round") for what in rounds) < 40
