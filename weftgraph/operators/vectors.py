"""Vectors: cosine neighbours, seed means, clusters, and node embeddings from random walks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.batches import bounded
from weftgraph.graph import Graph
from weftgraph.operators.paths import arcs
from weftgraph.ordered import within_keys
from weftgraph.stage import stage

#: Walks that a task should have at least, and steps of walks whose meetings are counted at once.
WALKS, POSITIONS = 2_000, 1 << 20
#: Vertices of a block: a sixteenth of all between these two.
SMALL, LARGE = 1024, 16384
#: Directions that are shorter than the longest by this factor, squared, are none.
_FLAT = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """A vector of length 1; one of zeros stays."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    n = norm(a) * norm(b)
    return dot(a, b) / F.when(n > 0, n)


def cosine_topk(vectors: DataFrame, id_: str, vector: str, node, k: int = 8) -> DataFrame:
    """id, similarity of the k nearest to one row, which is left out; none where it is missing or zero."""
    one = F.broadcast(vectors.filter(F.col(id_) == node).select(F.col(vector).alias("one")).limit(1))
    scored = vectors.filter(F.col(id_) != node).join(one).select(id_, cosine(F.col(vector), F.col("one")).alias("similarity"))
    return scored.filter("similarity is not null").orderBy(F.desc("similarity"), id_).limit(k)


def mean_vector(rows: DataFrame, vector: str) -> DataFrame:
    """One row: mean, by dimension."""
    each = rows.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("x"))
    return each.agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).getField("x").alias("mean"))


def seed_search(vectors: DataFrame, id_: str, vector: str, seeds: DataFrame, k: int = 8) -> DataFrame:
    """id, similarity of the k nearest to the mean of the seeds' unit vectors; seeds are left out."""
    units = vectors.select(id_, unit(F.col(vector)).alias("unit"))
    mean = F.broadcast(mean_vector(units.join(seeds.select(id_), id_, "left_semi"), "unit"))
    scored = units.join(seeds.select(id_), id_, "left_anti").join(mean).select(id_, cosine(F.col("unit"), F.col("mean")).alias("similarity"))
    return scored.filter("similarity is not null").orderBy(F.desc("similarity"), id_).limit(k)


def text_search(vectors: DataFrame, id_: str, vector: str, text: str, k: int = 8) -> DataFrame:
    """seed_search from the rows whose id holds a text, without regard to case; none where no id does."""
    return seed_search(vectors, id_, vector, vectors.filter(F.contains(F.lower(F.col(id_)), F.lit(text.lower()))).select(id_), k)


def save_embeddings(vectors: DataFrame, path: str) -> None:
    """Writes id and vector, of length 1, over what path held."""
    vectors.select("id", unit(F.col("vector")).alias("vector")).write.mode("overwrite").parquet(path)


def load_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, vector array<double>").parquet(path)


def kmeans(vectors: DataFrame, id_: str, vector: str, k: int = 6, seed: int = 42, starts: int = 10) -> DataFrame:
    """id, cluster; 2 to 20 clusters, of unit vectors: the best of so many starts, by the sum of squared distances."""
    ready = stage(vectors.select(id_, array_to_vector(unit(F.col(vector))).alias("features")), "kmeans-vectors")
    fits = (KMeans(k=max(2, min(20, k)), seed=seed + i, featuresCol="features", predictionCol="cluster").fit(ready) for i in range(starts))
    return min(fits, key=lambda m: m.summary.trainingCost).transform(ready).select(id_, "cluster")


def walks(g: Graph, per_node: int = 100, length: int = 20, seed: int = 42) -> DataFrame:
    """start, walk, path: uniform random walks, direction ignored. Steps are drawn by hashes, so reruns agree."""
    return _walked(arcs(g, directed=False).filter("x <> y").withColumn("start", F.col("x")), per_node, length, seed)


def _walked(both: DataFrame, per_node: int, length: int, seed: int) -> DataFrame:
    """start, walk, path of steps (x, y, start: what x is called in draws).

    Neighbours are numbered within a vertex; a walk draws a number, so a step is one equi-join however large the degree. An arc tells
    how many neighbours its end has, for the next draw.
    Walks are dealt to tasks by their start: the tables of steps may be small enough to be sent, and then no join deals them.
    """
    numbered = stage(within_keys(stage(both, "walk-both"), "x", ["y"], "walk-places").withColumnRenamed("place", "n"), "walk-numbers")
    degrees = stage(numbered.groupBy("x", "start").agg(F.count(F.lit(1)).alias("degree")), "walk-degrees")
    arcs_ = stage(numbered.drop("start").join(degrees.select(F.col("x").alias("y"), F.col("degree").alias("next")), "y"), "walk-arcs")
    spark, every = both.sparkSession, degrees.count() * per_node
    tasks = max(1, min(every // WALKS, max(4 * spark.sparkContext.defaultParallelism, every // (16 * WALKS))))
    front = degrees.repartition(tasks, "start").select("start", F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))).alias("walk"), F.array("x").alias("path"), F.col("x").alias("at"), "degree")
    for step in range(length - 1):
        drawn = front.withColumn("n", F.pmod(F.xxhash64("start", "walk", F.lit(step), F.lit(seed)), F.col("degree")))
        front = drawn.join(arcs_, (drawn["at"] == arcs_["x"]) & (drawn["n"] == arcs_["n"])).select("start", "walk", F.concat("path", F.array("y")).alias("path"), F.col("y").alias("at"), F.col("next").alias("degree"))
        if step % 5 == 4:
            front = stage(front, f"walk-{step}")
    return front.select("start", "walk", "path")


def co_visits(paths: DataFrame, window: int = 10) -> DataFrame:
    """x, y, n: how often two different vertices stand within `window` steps of each other on a path, both ways."""
    counts = _met(paths, window)
    return counts.unionByName(counts.select(F.col("y").alias("x"), F.col("x").alias("y"), "n"))


def _met(paths: DataFrame, window: int) -> DataFrame:
    """co_visits with x < y. Tasks count what many walks see before anything is dealt by vertices."""

    def count(path: pa.ListArray) -> pa.RecordBatch:
        told = path.flatten().dictionary_encode()
        order = np.asarray(pc.array_sort_indices(told.dictionary)).astype(np.int64)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at = rank[np.asarray(told.indices)]
        walk = np.repeat(np.arange(len(path)), np.asarray(pc.list_value_length(path)))
        keys = [np.zeros(0, np.int64)]
        for d in range(1, window + 1):
            a, b = at[:-d], at[d:]
            ok = (walk[:-d] == walk[d:]) & (a != b)
            keys.append((np.minimum(a, b) * len(order) + np.maximum(a, b))[ok])
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        x, y = (told.dictionary.take(pa.array(order[k])) for k in np.divmod(key, max(1, len(order))))
        return pa.record_batch({"x": x, "y": y, "n": pa.array(n.astype(np.int64))})

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch.column("path"))
            size += len(held[-1].flatten())
            if size >= POSITIONS:
                yield count(pa.concat_arrays(held))
                held, size = [], 0
        if held:
            yield count(pa.concat_arrays(held))

    kind = paths.schema["path"].dataType.elementType.simpleString()
    return paths.select("path").mapInArrow(run, f"x {kind}, y {kind}, n bigint").groupBy("x", "y").agg(F.sum("n").alias("n"))


def surprise(counts: DataFrame) -> DataFrame:
    """x, y, weight: positive pointwise mutual information of counts (x, y, n)."""
    own = counts.groupBy("x").agg(F.sum("n").alias("n_x"))
    total = counts.agg(F.sum("n").alias("total"))
    rows = counts.join(own, "x").join(own.select(F.col("x").alias("y"), F.col("n_x").alias("n_y")), "y").join(F.broadcast(total))
    return rows.select("x", "y", F.log(F.col("n") * F.col("total") / (F.col("n_x") * F.col("n_y"))).alias("weight")).filter("weight > 0")


def _dealt(n: int) -> tuple[int, int]:
    """Blocks to which so many vertices are dealt in turn, and the places of each: vertex v has place v // blocks of block v % blocks."""
    blocks = max(1, math.ceil(n / min(LARGE, max(SMALL, n // 16))))
    return blocks, max(1, math.ceil(n / blocks))


def _tasks(spark: SparkSession, blocks: int) -> int:
    """Tasks of all tiles."""
    return min(blocks * (blocks + 1) // 2, 4 * spark.sparkContext.defaultParallelism)


def _binary(*columns) -> pa.RecordBatch:
    """A row of numbers and of arrays, these by their bytes."""
    return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) if isinstance(c, np.ndarray) else pa.array([int(c)], pa.int32()) for c in columns], [str(i) for i in range(len(columns))])


def _named(batches, *names: str):
    for batch in batches:
        yield batch.rename_columns(list(names))


def _tiles(paths: DataFrame, window: int, blocks: int, size: int) -> DataFrame:
    """a, b, keys, counts: co_visits of numbered vertices, once for both ways, by tiles of the blocks a <= b.

    A key is the place in a times size, plus the place in b, ascending. Tasks count what many walks see, and send what they counted of
    a tile as one row, not as a row for each pair.
    """
    square = size * size

    def count(path: pa.ListArray):
        at = np.asarray(path.flatten()).astype(np.int64)
        block, place = at % blocks, at // blocks
        order = block * size + place
        walk = np.repeat(np.arange(len(path)), np.asarray(pc.list_value_length(path)))
        keys = [np.zeros(0, np.int64)]
        for d in range(1, window + 1):
            ok = (walk[:-d] == walk[d:]) & (at[:-d] != at[d:])
            low, high = np.minimum(order[:-d], order[d:])[ok], np.maximum(order[:-d], order[d:])[ok]
            keys.append(((low // size) * blocks + high // size) * square + (low % size) * size + high % size)
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        tile, key = np.divmod(key, square)
        ends = [0, *(np.flatnonzero(np.diff(tile)) + 1).tolist(), len(tile)]
        for lo, hi in zip(ends, ends[1:]):
            if hi > lo:
                yield _binary(*divmod(int(tile[lo]), blocks), key[lo:hi].astype(np.int32), n[lo:hi].astype(np.int32))

    def run(batches):
        held, length = [], 0
        for batch in batches:
            held.append(batch.column("path"))
            length += len(held[-1].flatten())
            if length >= POSITIONS:
                yield from _named(count(pa.concat_arrays(held)), "a", "b", "keys", "counts")
                held, length = [], 0
        if held:
            yield from _named(count(pa.concat_arrays(held)), "a", "b", "keys", "counts")

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        keys, counts = (np.concatenate([np.frombuffer(x, np.int32) for x in rows[c].to_pylist()]).astype(np.int64) for c in ("keys", "counts"))
        both = np.sort(keys << 32 | counts)
        keys, counts = both >> 32, both & 0xFFFFFFFF
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        out = _binary(key[0].as_py(), key[1].as_py(), keys[first].astype(np.int32), np.add.reduceat(counts, first))
        return pa.Table.from_batches([out]).rename_columns(["a", "b", "keys", "counts"])

    sent = paths.select("path").mapInArrow(run, "a int, b int, keys binary, counts binary")
    return sent.repartition(_tasks(paths.sparkSession, blocks), "a", "b").groupBy("a", "b").applyInArrow(merge, "a int, b int, keys binary, counts binary")


def _added(parts: DataFrame, value: str) -> DataFrame:
    """block, value: the sum of the arrays of doubles that parts have of each block."""

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = None
        for chunk in rows[value].chunks:
            for x in chunk:
                one = np.frombuffer(x.as_buffer(), np.float64)
                total = one.copy() if total is None else np.add(total, one, out=total)
        return pa.Table.from_batches([_binary(key[0].as_py(), total)]).rename_columns(["block", value])

    return parts.groupBy("block").applyInArrow(add, f"block int, {value} binary")


def _with_sides(tiles: DataFrame, side: DataFrame, value: str, blocks: int) -> DataFrame:
    """tiles with what side has of both blocks, as value_a and value_b; dealt by tile, as a block alone has many."""
    a = side.select(F.col("block").alias("a"), F.explode(F.sequence("block", F.lit(blocks - 1))).alias("b"), F.col(value).alias(f"{value}_a"))
    b = side.select(F.explode(F.sequence(F.lit(0), "block")).alias("a"), F.col("block").alias("b"), F.col(value).alias(f"{value}_b"))
    return bounded(tiles.repartition(_tasks(tiles.sparkSession, blocks), "a", "b").join(a, ["a", "b"]).join(b, ["a", "b"]))


def _rows(batches):
    """Rows of batches as dicts, one at a time: arrays as their buffers."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: x.as_buffer() if isinstance(x := batch.column(c)[i], pa.BinaryScalar) else x.as_py() for c in batch.schema.names}


def _weighed(counts: DataFrame, blocks: int, size: int) -> DataFrame:
    """a, b, keys, weights: surprise of the counts of tiles, where it is positive."""

    def ends(batches):
        for r in _rows(batches):
            x, y = np.divmod(np.frombuffer(r["keys"], np.int32), size)
            n = np.frombuffer(r["counts"], np.int64)
            for block, at in ((r["a"], x), (r["b"], y)):
                yield from _named([_binary(block, np.bincount(at, n, size))], "block", "seen")

    def weigh(batches):
        for r in _rows(batches):
            keys, n = np.frombuffer(r["keys"], np.int32), np.frombuffer(r["counts"], np.int64)
            x, y = np.divmod(keys, size)
            weight = np.log(n * total / (np.frombuffer(r["seen_a"], np.float64)[x] * np.frombuffer(r["seen_b"], np.float64)[y]))
            ok = weight > 0
            if ok.any():
                yield from _named([_binary(r["a"], r["b"], keys[ok], weight[ok].astype(np.float32))], "a", "b", "keys", "weights")

    own = stage(_added(bounded(counts).mapInArrow(ends, "block int, seen binary"), "seen"), "walk-seen")

    def sums(batches):
        for r in _rows(batches):
            yield pa.record_batch({"n": pa.array([np.frombuffer(r["seen"], np.float64).sum()])})

    total = own.mapInArrow(sums, "n double").agg(F.sum("n")).first()[0]
    return _with_sides(counts, own, "seen", blocks).mapInArrow(weigh, "a int, b int, keys binary, weights binary")


def _product(row: np.ndarray, column: np.ndarray, weights: np.ndarray, side: np.ndarray, size: int) -> np.ndarray:
    """The matrix of weights in rows, ascending, and columns times side."""
    out = np.zeros((size, side.shape[1]))
    first = np.flatnonzero(np.diff(row, prepend=-1))
    for r, lo, hi in zip(row[first].tolist(), first.tolist(), [*first[1:].tolist(), len(row)]):
        out[r] = weights[lo:hi] @ side.take(column[lo:hi], axis=0)
    return out


def _times(tiles: DataFrame, side: DataFrame, turn: np.ndarray, blocks: int, size: int) -> DataFrame:
    """block, rows: the symmetric matrix of the tiles' weights times side (block, rows: size by dimensions) times turn."""

    def run(batches):
        for r in _rows(batches):
            x, y = np.divmod(np.frombuffer(r["keys"], np.int32), size)
            weights = np.frombuffer(r["weights"], np.float32).astype(np.float64)
            left, right = (np.frombuffer(r[c], np.float64).reshape(size, -1) @ turn for c in ("rows_a", "rows_b"))
            yield from _named([_binary(r["a"], _product(x, y, weights, right, size))], "block", "rows")
            order = np.argsort(y.astype(np.int16), kind="stable")  # a block has fewer places than these hold
            yield from _named([_binary(r["b"], _product(y[order], x[order], weights[order], left, size))], "block", "rows")

    return _added(_with_sides(tiles, side, "rows", blocks).mapInArrow(run, "block int, rows binary"), "rows")


def _inner(sides: DataFrame, one: str, other: str, dim: int) -> np.ndarray:
    """The products of the columns of two sides that stand in a row of each block; the driver gets dim by dim numbers of a task."""

    def run(batches):
        total = np.zeros((dim, dim))
        for r in _rows(batches):
            total += np.frombuffer(r[one], np.float64).reshape(-1, dim).T @ np.frombuffer(r[other], np.float64).reshape(-1, dim)
        yield pa.record_batch({"total": pa.array([total.tobytes()], pa.binary())})

    return sum(np.frombuffer(r.total, np.float64).reshape(dim, dim) for r in bounded(sides).mapInArrow(run, "total binary").collect())


def _power(symmetric: np.ndarray, power: float) -> np.ndarray:
    """A power of the positive part of a symmetric matrix. Unlike its eigenvectors it doesn't turn where eigenvalues are equal."""
    value, vector = np.linalg.eigh((symmetric + symmetric.T) / 2)
    ok = value > _FLAT * max(value[-1], 0.0)
    return (vector[:, ok] * value[ok] ** power) @ vector[:, ok].T


def node_embeddings(g: Graph, dim: int = 64, per_node: int = 100, length: int = 20, window: int = 10, seed: int = 42, least: int = 5, rounds: int = 5) -> DataFrame:
    """id, vector (unit length) of vertices with edges; none for a graph of fewer than `least` vertices.

    What random walks see together is weighted by how surprising it is. Vectors span what that matrix keeps of random ones after so many
    products with it, and their products are nearest to its own. It lies in tiles of two blocks of vertices; a task multiplies a
    tile with two blocks, so no task and no driver holds all. The driver holds products of dimensions.
    """
    nothing = g.spark.createDataFrame([], "id string, vector array<double>")
    if len(g.v.limit(least).take(least)) < least:
        return nothing
    both = stage(arcs(g, directed=False).filter("x <> y"), "walk-steps")
    ids = both.select(F.col("x").alias("id")).distinct().withColumn("one", F.lit(0))
    numbers = stage(within_keys(ids, "one", ["id"], "walk-numbers").select("id", F.col("place").cast("int").alias("n")), "walk-numbered")
    x, y = (numbers.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}")) for c in "xy")
    steps = both.join(x, "x").join(y, "y").select(F.col("n_x").alias("x"), F.col("n_y").alias("y"), F.col("x").alias("start"))
    blocks, size = _dealt(numbers.count())
    counts = stage(_tiles(stage(_walked(steps, per_node, length, seed).select("path"), "walks"), window, blocks, size), "walk-counts")
    if counts.isEmpty():
        return nothing
    tiles = stage(_weighed(counts, blocks, size), "walk-weights")

    def begin(batches):
        for block in (b for batch in batches for b in batch.column("id").to_pylist()):
            yield from _named([_binary(block, np.random.default_rng([seed, block]).normal(size=(size, dim)))], "block", "rows")

    side, turn = stage(g.spark.range(blocks).mapInArrow(begin, "block int, rows binary"), "walk-side"), np.eye(dim)
    for _ in range(rounds):
        side = stage(_times(tiles, side, turn, blocks, size), "walk-side")
        turn = _power(_inner(side, "rows", "rows", dim), -0.5)
    pair = side.join(stage(_times(tiles, side, turn, blocks, size), "walk-side").withColumnRenamed("rows", "next"), "block")
    turn = turn @ _power(turn.T @ _inner(pair, "rows", "next", dim), 0.5)

    def end(batches):
        for r in _rows(batches):
            seen = np.flatnonzero(np.frombuffer(r["next"], np.float64).reshape(-1, dim).any(1))
            rows = np.frombuffer(r["rows"], np.float64).reshape(-1, dim)[seen] @ turn
            vector = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, dim, dtype=np.int32), pa.array(rows.ravel()))
            yield pa.record_batch({"n": pa.array((seen * blocks + r["block"]).astype(np.int32)), "vector": vector})

    return bounded(pair).mapInArrow(end, "n int, vector array<double>").join(numbers, "n").select("id", unit(F.col("vector")).alias("vector"))
