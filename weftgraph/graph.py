"""A property graph as two DataFrames.

Nulls stay in storage; each operator supplies its own default, because readers of a missing attribute differ in theirs.
`seq` is the order of arrival where the source has one; ties are broken by it, then by id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.stage import stage

VERTICES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("group", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("title", T.StringType()),
        T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
        T.StructField("seq", T.LongType()),
    ]
)
EDGES = T.StructType(
    [
        T.StructField("src", T.StringType()),
        T.StructField("dst", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("seq", T.LongType()),
    ]
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the columns of schema, in order; those it lacks are null."""
    return df.select(*((F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


@dataclass(frozen=True)
class Graph:
    """vertices and edges; at most one edge for each ordered pair, self-loops allowed."""

    v: DataFrame
    e: DataFrame

    @staticmethod
    def of(vertices: DataFrame, edges: DataFrame) -> Graph:
        return Graph(conform(vertices, VERTICES), conform(edges, EDGES))

    @staticmethod
    def literal(spark: SparkSession, vertices: list[tuple], edges: list[tuple]) -> Graph:
        """From (id, group[, confidence]) and (src, dst, label[, confidence[, weight]]) tuples, in order of arrival."""
        v = [(*x, *[None] * (3 - len(x)), None, None, i) for i, x in enumerate(vertices)]
        e = [(*x, *[None] * (5 - len(x)), i) for i, x in enumerate(edges)]
        return Graph(spark.createDataFrame(v, VERTICES), spark.createDataFrame(e, EDGES))

    @staticmethod
    def empty(spark: SparkSession) -> Graph:
        return Graph.literal(spark, [], [])

    @property
    def spark(self) -> SparkSession:
        return self.v.sparkSession

    def staged(self, name: str = "graph") -> Graph:
        """Written to the shared folder; for operators that read the graph many times."""
        return Graph(stage(self.v, f"{name}-v"), stage(self.e, f"{name}-e"))

    def induced(self, ids: DataFrame) -> Graph:
        """The vertices in ids (a column id) and the edges with both ends among them."""
        ids = ids.select("id").distinct()
        e = self.e.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
        return Graph(self.v.join(ids, "id", "left_semi"), conform(e, EDGES))
