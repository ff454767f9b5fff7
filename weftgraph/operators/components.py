"""Connected components of a graph of ids of any ordered type, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.stage import stage


def components(edges: DataFrame) -> DataFrame:
    """id, root for each end of an edge (a, b) that isn't a self-loop; root is the smallest id of its component.

    Each round hangs every node on its smallest neighbour if that is smaller, follows these links to their ends, and
    contracts the edges. Links go to smaller ids, so they end; a round leaves fewer edges, and forests of stars, which
    union-find makes, are done in one. Rounds are written to the shared folder.
    """
    edges = stage(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    result = None
    while not edges.isEmpty():
        link = stage(edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("up")), "cc-links")
        while True:
            above = link.select(F.col("id").alias("up"), F.col("up").alias("upper"))
            if link.join(above, "up", "left_semi").isEmpty():
                break
            link = stage(link.join(above, "up", "left").select("id", F.coalesce("upper", "up").alias("up")), "cc-jumps")
        if result is None:
            result = link
        else:
            onward = link.select(F.col("id").alias("up"), F.col("up").alias("upper"))
            result = stage(result.join(onward, "up", "left").select("id", F.coalesce("upper", "up").alias("up")).unionByName(link), "cc-roots")
        a, b = link.select(F.col("id").alias("a"), F.col("up").alias("ua")), link.select(F.col("id").alias("b"), F.col("up").alias("ub"))
        moved = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ua", "a").alias("x"), F.coalesce("ub", "b").alias("y"))
        edges = stage(moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-edges")
    if result is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    hung = result.groupBy("id").agg(F.min("up").alias("root"))
    return hung.unionByName(hung.select(F.col("root").alias("id")).distinct().select("id", F.col("id").alias("root")))
