"""Spanning forests and Euler tours, in rounds that grow with the logarithm of the graph; bridges by sums over subtrees.

A tree with both directions of each edge is one closed walk: after the step from x to y comes the step from y to the neighbour after
x. Pointer doubling tells each step's distance to the walk's end. A subtree is then a stretch of the walk, and a sum
over it the difference of two running sums. Joins are on keys that occur once, or on vertices whose other side is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.ordered import MODULUS, within_keys
from weftgraph.stage import stage


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) of a spanning forest of edges (a, b), and id, root of each end: the smallest id of its tree.

    Each round hangs every tree on its smallest neighbour if that is smaller, by one edge, and joins the trees that hang together.
    """
    ends = F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = stage(edges.filter("a <> b").select(ends.alias("own")).distinct().select("own.a", "own.b", "own"), "forest-edges")
    tree = result = None
    while not left.isEmpty():
        hung = stage(left.groupBy(F.col("b").alias("id")).agg(F.min(F.struct("a", "own")).alias("x")).select("id", F.col("x.a").alias("up"), "x.own"), "forest-links")
        tree = hung.select("own.a", "own.b") if tree is None else tree.unionByName(hung.select("own.a", "own.b"))
        link = hung.select("id", "up")
        while True:
            above = link.select(F.col("id").alias("up"), F.col("up").alias("upper"))
            if link.join(above, "up", "left_semi").isEmpty():
                break
            link = stage(link.join(above, "up", "left").select("id", F.coalesce("upper", "up").alias("up")), "forest-jumps")
        if result is None:
            result = link
        else:
            onward = link.select(F.col("id").alias("up"), F.col("up").alias("upper"))
            result = stage(result.join(onward, "up", "left").select("id", F.coalesce("upper", "up").alias("up")).unionByName(link), "forest-roots")
        a, b = link.select(F.col("id").alias("a"), F.col("up").alias("ua")), link.select(F.col("id").alias("b"), F.col("up").alias("ub"))
        moved = left.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ua", "a").alias("x"), F.coalesce("ub", "b").alias("y"), "own").filter("x <> y")
        left = stage(moved.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("own").alias("own")), "forest-edges")
    if tree is None:
        return left.select("a", "b"), left.select(F.col("a").alias("id"), F.col("b").alias("root"))
    ids = result.select("id", F.col("up").alias("root"))
    return stage(tree, "forest-tree"), stage(ids.unionByName(ids.select(F.col("root").alias("id")).distinct().select("id", F.col("id").alias("root"))), "forest-ids")


def euler_tour(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """x, y, root, after of each step of the walks round the trees of a forest: how many steps come after it; a walk starts at the root."""
    both = stage(tree.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(tree.select(F.col("b").alias("x"), F.col("a").alias("y"))).withColumn("one", F.lit(0)), "tour-arcs")
    placed = stage(within_keys(both, "one", ["x", "y"], "tour-places").select("x", "y", F.col("place").alias("i")), "tour-numbers")
    own = stage(placed.groupBy("x").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("degree")), "tour-degrees")
    later = placed.join(own, "x").select(F.col("x").alias("y"), F.col("y").alias("x"), F.when(F.col("i") + 1 < F.col("first") + F.col("degree"), F.col("i") + 1).otherwise(F.col("first")).alias("next"))
    starts = roots.filter("id = root").join(own, F.col("id") == F.col("x")).select(F.col("first").alias("next"), F.lit(True).alias("start"))
    steps = placed.join(later, ["x", "y"]).join(starts, "next", "left").withColumn("jump", F.when(F.col("start").isNull(), F.col("next")))
    state = stage(steps.select("i", "jump", F.when(F.col("jump").isNull(), 0).otherwise(1).cast("bigint").alias("after")), "tour-round")
    while not state.filter("jump is not null").isEmpty():
        there = state.select(F.col("i").alias("jump"), F.col("jump").alias("onward"), F.col("after").alias("more"))
        state = stage(state.join(there, "jump", "left").select("i", F.col("onward").alias("jump"), (F.col("after") + F.coalesce("more", F.lit(0))).alias("after")), "tour-round")
    return placed.join(state, "i").join(roots.withColumnRenamed("id", "x"), "x").select("x", "y", "root", "after")


def bridges(g: Graph) -> DataFrame:
    """a < b: connections whose removal parts a component, direction ignored.

    An edge outside a spanning forest is never a bridge. A forest edge is one if no other edge leaves the subtree under it: each of those
    has a random 64-bit number (a hash, in two halves) that is added at one end and taken away at the other, so that a subtree's sum
    is zero if all that it touches stays inside; another sum is zero with probability 2^-64.
    """
    e = stage(g.e.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(), "bridge-edges")
    tree, roots = spanning_forest(e)
    if tree.isEmpty():
        return e
    mark = F.xxhash64("a", "b")
    halves = [F.pmod(mark, F.lit(MODULUS)), F.pmod(F.shiftright(mark, 32), F.lit(MODULUS))]
    other = e.join(tree, ["a", "b"], "left_anti")
    marks = other.select(F.col("a").alias("y"), *(h.alias(f"m{i}") for i, h in enumerate(halves))).unionByName(other.select(F.col("b").alias("y"), *(F.pmod(-h, F.lit(MODULUS)).alias(f"m{i}") for i, h in enumerate(halves))))
    marks = stage(marks.groupBy("y").agg(*(F.pmod(F.sum(f"m{i}"), F.lit(MODULUS)).alias(f"m{i}") for i in (0, 1))), "bridge-marks")
    tour = stage(euler_tour(tree, roots), "bridge-tour")
    back = tour.select(F.col("x").alias("y"), F.col("y").alias("x"), F.col("after").alias("back"))
    steps = tour.join(back, ["x", "y"]).withColumn("down", F.col("after") > F.col("back")).join(marks, "y", "left")
    value = [F.when(F.col("down"), F.coalesce(f"m{i}", F.lit(0))).otherwise(0).cast("bigint") for i in (0, 1)]
    rows = stage(steps.select("x", "y", "root", "down", (-F.col("after")).alias("order"), *(v.alias(f"m{i}") for i, v in enumerate(value)), *(v.alias(f"sum{i}") for i, v in enumerate(value))), "bridge-steps")
    summed = stage(within_keys(rows, "root", ["order"], "bridge-sums", ("sum0", "sum1")), "bridge-summed")
    # the stretch from the step down to y to the step up from it is y's subtree
    up = summed.filter("not down").select(F.col("y").alias("x"), F.col("x").alias("y"), F.col("sum0").alias("up0"), F.col("sum1").alias("up1"))
    whole = summed.filter("down").join(up, ["x", "y"])
    crossed = [F.pmod(F.col(f"up{i}") - F.col(f"sum{i}") + F.col(f"m{i}"), F.lit(MODULUS)) for i in (0, 1)]
    return whole.filter((crossed[0] == 0) & (crossed[1] == 0)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def critical_edges(g: Graph) -> DataFrame:
    """a, b, label, components of each bridge: the label of the edge from a to b, or else back; components there would be without it."""
    from weftgraph.operators.paths import wcc_count

    n = wcc_count(g).select((F.col("components") + 1).alias("components"))
    e = g.e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min(F.struct(F.col("src") > F.col("dst"), F.coalesce("label", F.lit("")).alias("label"))).alias("x"))
    return bridges(g).join(e, ["a", "b"]).join(F.broadcast(n)).select("a", "b", F.col("x.label").alias("label"), "components")
