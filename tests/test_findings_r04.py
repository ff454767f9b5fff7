"""What the findings of round 4 are about, on small inputs."""

import random

import numpy as np
import pytest

from tests.test_graph import g
from weftgraph.operators import matching, mutate, vectors


def _plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_of_names_are_never_sent_by_the_driver(spark, monkeypatch):
    """However small the files of names are: they are compressed, and what is sent of them is not."""
    plans, own = [], mutate.stage
    for module in (mutate, matching):
        monkeypatch.setattr(module, "stage", lambda df, name: plans.append(_plan(df)) or own(df, name))
    ids = [f"Customer#{i:09}" for i in range(60)]
    v = own(spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "id string, seq long"), "ids")
    names = own(spark.createDataFrame([(x,) for i in ids for x in (i.lower(), i.lower() + "x", "tiber")], "name string"), "names")
    aliases = own(spark.createDataFrame([("Tiber", ids[3])], "alias string, id string"), "aliases")
    got = mutate.resolve(names, v, aliases=aliases)
    plans.append(_plan(got))
    assert {r.name: r.id for r in got.collect()} == {x: i for i in ids for x in (i.lower(), i.lower() + "x")} | {"tiber": ids[3]}
    assert len(plans) > 4 and not [p for p in plans if "Broadcast" in p]


@pytest.mark.parametrize("small", [3, 1024])
def test_weights_of_tiles_by_the_rows_of_pairs(spark, monkeypatch, small):
    """Tiles hold the same counts and weights as rows of pairs, and their products are the matrix's."""
    monkeypatch.setattr(vectors, "SMALL", small)
    monkeypatch.setattr(vectors, "POSITIONS", 60)
    r = random.Random(3)
    walks = spark.createDataFrame([([r.choice([r.randrange(25), 7]) for _ in range(r.randrange(0, 12))],) for _ in range(50)], "path array<int>")
    blocks, size = vectors._dealt(25)
    assert blocks == (9 if small == 3 else 1)
    tiles = vectors._weighed(vectors._tiles(walks, 4, blocks, size), blocks, size)
    got = {}
    for t in tiles.collect():
        for key, w in zip(np.frombuffer(t.keys, np.int32).tolist(), np.frombuffer(t.weights, np.float32).tolist()):
            x, y = key // size * blocks + t.a, key % size * blocks + t.b
            assert (x, y) not in got and (y, x) not in got
            got[x, y] = got[y, x] = w
    want = {(x.x, x.y): x.weight for x in vectors.surprise(vectors.co_visits(walks, 4)).collect()}
    assert len(want) > 100 and got == pytest.approx(want, rel=1e-6)
    matrix, side, turn = np.zeros((blocks * size,) * 2), np.random.default_rng(1).normal(size=(blocks * size, 3)), np.array([[1.0, 2, 0], [0, 1, 0], [3, 0, 1]])
    for (x, y), w in got.items():
        matrix[x, y] = w
    rows = [(b, bytearray(np.ascontiguousarray(side[b::blocks]).tobytes())) for b in range(blocks)]
    made = vectors._times(tiles, spark.createDataFrame(rows, "block int, rows binary"), turn, blocks, size).collect()
    for t in made:
        assert np.allclose(np.frombuffer(t.rows, np.float64).reshape(size, 3), (matrix @ side @ turn)[t.block :: blocks])


def test_embeddings_do_not_depend_on_how_rows_are_dealt(spark):
    """The number of partitions is no part of the vectors; those of three cliques stay together by inner products."""
    edges = [(f"c{c}_{i}", f"c{c}_{j}", "l") for c in range(3) for i in range(6) for j in range(i)] + [(f"c{c}_0", f"c{c + 1}_0", "l") for c in range(2)]
    graph, was, got = g(spark, edges, [(v, "x") for v in sorted({v for e in edges for v in e[:2]})]), spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in ("4", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got.append({r.id: np.array(r.vector) for r in vectors.node_embeddings(graph, dim=8, per_node=10, length=10, window=4).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert len(got[0]) == 18 and all(np.allclose(got[0][v], got[1][v], atol=1e-6) and abs(np.linalg.norm(got[0][v]) - 1) < 1e-9 for v in got[0])
    for v in got[0]:
        near = sorted((u for u in got[0] if u != v), key=lambda u: -got[0][u] @ got[0][v])[:5]
        assert all(u[:2] == v[:2] for u in near), v
