"""Tables that micro-batches write: a log to which each batch adds rows once, and a graph of which a batch rewrites what it touches.

Both live in a folder that all machines share. A version counts once its marker is there, which is moved into place whole;
what a batch writes before that is written again if it is run again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.graph import EDGES, VERTICES, Graph


class Files:
    """Small files and folders of a store, by Spark's own file systems."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, at: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)

    def names(self, folder: str = "") -> list[str]:
        p = self.path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, name: str) -> str | None:
        p = self.path(f"{self.root}/{name}")
        if not self.fs.exists(p):
            return None
        stream = self.fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """The whole file or nothing: written beside it, then moved."""
        new, at = self.path(f"{self.root}/.{name.replace('/', '_')}-{uuid.uuid4().hex}"), self.path(f"{self.root}/{name}")
        stream = self.fs.create(new, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.fs.mkdirs(at.getParent())
        if self.fs.exists(at):
            self.fs.delete(at, False)
        self.fs.rename(new, at)

    def drop(self, name: str = "") -> None:
        self.fs.delete(self.path(f"{self.root}/{name}" if name else self.root), True)


class BatchLog:
    """A table to which each batch adds rows once: a batch that is run again replaces what it wrote.

    Every `compact` batches their folders are put together into one, marked before the others go; folders that a finished larger one
    covers are not read, so a crash at any point loses and doubles nothing. The newest `keep` batches stay apart.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, keep: int = 5, compact: int = 100) -> None:
        self.spark, self.schema, self.keep, self.compact = spark, schema, keep, compact
        self.files = Files(spark, root)

    def ranges(self) -> list[tuple[int, int]]:
        """The first and last batch of each finished folder that counts."""
        done = sorted(tuple(map(int, n[:-5].split("-"))) for n in self.files.names() if n.endswith(".done") and n[0] != ".")
        return [r for r in done if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in done)]

    @staticmethod
    def _name(low: int, high: int) -> str:
        return f"{low:012d}-{high:012d}"

    def batches(self) -> int:
        """The newest batch; -1 for none."""
        return max((high for _, high in self.ranges()), default=-1)

    def read(self, upto: int | None = None) -> DataFrame:
        """Rows of all batches, or of those up to one; a column `batch` tells which."""
        found = [self._name(*r) for r in self.ranges() if upto is None or r[1] <= upto]
        schema = f"batch bigint, {self.schema}"
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.files.root}/{n}" for n in found))

    def write(self, batch: int, rows: DataFrame) -> None:
        if any(low <= batch <= high and low != high for low, high in self.ranges()):
            raise ValueError(f"batch {batch} was put together with others already")
        columns = self.spark.createDataFrame([], self.schema).columns
        name = self._name(batch, batch)
        rows.select(F.lit(batch).cast("bigint").alias("batch"), *columns).write.mode("overwrite").parquet(f"{self.files.root}/{name}")
        self.files.write(f"{name}.done", "")
        self._tidy(batch)

    def _tidy(self, batch: int) -> None:
        every = self.ranges()
        small = [r for r in every if r[0] == r[1] and r[1] <= batch - self.keep]
        if len(small) >= self.compact:
            name = self._name(small[0][0], small[-1][1])
            whole = self.spark.read.schema(f"batch bigint, {self.schema}").parquet(*(f"{self.files.root}/{self._name(*r)}" for r in small))
            whole.coalesce(max(1, len(small) // 50)).write.mode("overwrite").parquet(f"{self.files.root}/{name}")
            self.files.write(f"{name}.done", "")
        live = {self._name(*r) for r in self.ranges()}
        for n in self.files.names():  # what a larger folder covers: the marker goes first
            if n.endswith(".done") and n[0] != "." and n[:-5] not in live:
                self.files.drop(n)
                self.files.drop(n[:-5])

    def clear(self) -> None:
        self.files.drop()


def bucket(columns: Iterable[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


class GraphStore:
    """A graph in versions, of which each has only the buckets that its batch touched, and the keys of extractions of each batch.

    Vertices are dealt to buckets by their id, edges by both ends, so a hub's edges are spread. A version's manifest names for each
    bucket the version that wrote it last, and the owner: whatever runs the batches, a checkpoint for a stream. Batch n makes
    version n from version n - 1, so a batch that is run again gives the same version; a batch that would leave a gap, lies
    behind the store, or is another owner's is refused. The newest `keep` versions can be read; buckets that none of them needs go.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 5, compact: int = 100, buckets: int = 64) -> None:
        self.spark, self.keep = spark, keep
        self.files = Files(spark, root)
        self.seen = BatchLog(spark, f"{self.files.root}/seen", "key string", keep, compact)
        told = [self._manifest(v) for v in self.versions()[-1:]]
        self.buckets = told[0]["buckets"] if told else buckets

    def versions(self) -> list[int]:
        """The finished versions, the oldest first."""
        return [int(n[1:-5]) for n in self.files.names() if n[0] == "v" and n.endswith(".json")]

    def newest(self) -> int:
        return max(self.versions(), default=-1)

    def _manifest(self, version: int) -> dict:
        told = self.files.read(f"v{version:012d}.json") if version >= 0 else None
        if told is None:
            if version >= 0:
                raise ValueError(f"the store has no version {version}")
            return {"owner": None, "buckets": self.buckets, "vertices": {}, "edges": {}}
        return json.loads(told)

    def before(self, batch: int, owner: str = "") -> int:
        """The version that a batch starts from, -1 for none."""
        done = self.versions()
        base = max((v for v in done if v < batch), default=-1)
        if done and done[-1] > batch:
            raise ValueError(f"the store has version {done[-1]} already; batch {batch} is of another checkpoint")
        if base != batch - 1:
            raise ValueError(f"the store ends at version {base}; batch {batch} would leave a gap")
        if done and (was := self._manifest(done[-1])["owner"]) != owner:
            raise ValueError(f"the store belongs to {was!r}, not to {owner!r}")
        return base

    def part(self, version: int, vertices: set[int] | None = None, edges: set[int] | None = None) -> Graph:
        """A version's graph, or those buckets of it."""
        told = self._manifest(version)

        def read(kind: str, wanted: set[int] | None, schema) -> DataFrame:
            at = [f"{self.files.root}/parts/{v:012d}/{kind}/bucket={b}" for b, v in told[kind].items() if wanted is None or int(b) in wanted]
            return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

        return Graph(read("vertices", vertices, VERTICES), read("edges", edges, EDGES))

    def load(self, version: int) -> tuple[Graph, DataFrame | None]:
        """A version's graph and all keys up to it; an empty graph for -1."""
        return self.part(version), self.seen.read(version).select("key") if version >= 0 else None

    def touched(self, ids: DataFrame, pairs: DataFrame) -> tuple[set[int], set[int]]:
        """The buckets of vertices (id) and of edges (src, dst); the driver gets a number for each at most."""
        own = ids.select(bucket(["id"], self.buckets).alias("b")).distinct().collect()
        return {r.b for r in own}, {r.b for r in pairs.select(bucket(["src", "dst"], self.buckets).alias("b")).distinct().collect()}

    def save(self, version: int, g: Graph, keys: DataFrame, touched: tuple[set[int], set[int]] | None = None, owner: str = "") -> None:
        """Writes a version; keys: those that it adds; touched: the buckets of vertices and of edges that g has, all by default."""
        base = max((v for v in self.versions() if v < version), default=-1)
        told = {"owner": owner, "buckets": self.buckets, **{k: dict(self._manifest(base)[k]) for k in ("vertices", "edges")}}
        for kind, df, by, own in (("vertices", g.v, ["id"], touched and touched[0]), ("edges", g.e, ["src", "dst"], touched and touched[1])):
            own = set(range(self.buckets)) if touched is None else own
            for b in own:
                told[kind].pop(str(b), None)
            if not own:
                continue
            at = f"parts/{version:012d}/{kind}"
            rows = df.withColumn("bucket", bucket(by, self.buckets)).filter(F.col("bucket").isin(*own))
            rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.files.root}/{at}")
            told[kind].update({n[len("bucket=") :]: version for n in self.files.names(at) if n.startswith("bucket=")})
        self.seen.write(version, keys)
        self.files.write(f"v{version:012d}.json", json.dumps(told))
        self._tidy()

    def _tidy(self) -> None:
        every = self.versions()
        for old in every[: -self.keep]:
            self.files.drop(f"v{old:012d}.json")
        needed = {(kind, int(b), v) for n in every[-self.keep :] for kind in ("vertices", "edges") for b, v in self._manifest(n)[kind].items()}
        for name in self.files.names("parts"):
            if int(name) > every[-1]:
                continue
            for kind in ("vertices", "edges"):
                own = {int(n[len("bucket=") :]) for n in self.files.names(f"parts/{name}/{kind}") if n.startswith("bucket=")}
                gone = {b for b in own if (kind, b, int(name)) not in needed}
                if gone == own:
                    self.files.drop(f"parts/{name}/{kind}")
                else:
                    for b in gone:
                        self.files.drop(f"parts/{name}/{kind}/bucket={b}")
            if not self.files.names(f"parts/{name}"):
                self.files.drop(f"parts/{name}")

    def clear(self) -> None:
        """Deletes all versions and all keys."""
        self.files.drop()
