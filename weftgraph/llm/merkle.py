"""A Merkle manifest of a dataset: a leaf for each row, a tree for each source, a tree over the sources, and proofs.

A leaf is the digest of a row's fields; a tree joins every three consecutive nodes, level by level, until one remains. Rows get
their place in their source without a task that holds a source (`ordered.py`). Blocks of 3^HEIGHT consecutive nodes are then
reduced wherever they land, each node keeping its path inside the block, and the block's root is a node of a smaller forest.
That goes on until at most TOP nodes are left; the driver builds the trees over these and broadcasts for each of them the
rest of the way to the root (a suffix path). Tasks join a row's path with the suffix of its block and fold the row's leaf along it.
If there are more sources than TOP, their subroots are themselves reduced by blocks, as one tree.

A path has 64 bytes for each sibling and 2 for each level, about 130 log3(rows) bytes. The suffixes have at most TOP paths.

Cases: null fields are written `-`; rows without a source are a source of their own, the first; rows without doc_id are the first
of their source; rows that tie in source and doc_id are ordered by leaf, and equal rows are leaves each; a null doc_id is never
tampered with; a long text is digested whole, by Spark's own function; other columns are not read, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.batches import bounded
from weftgraph.ordered import within_keys
from weftgraph.stage import stage

FAN = 3
#: Levels that a block joins, and the most nodes of which the driver gets digests.
HEIGHT, TOP = 6, 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree over the sources.
SOURCES = ""


def digest(nodes: list[bytes]) -> bytes:
    """The digest of digests, which are joined as hexadecimal text."""
    return hashlib.sha256(b"".join(nodes).hex().encode()).digest()


def leaf(values: dict[str, Column]) -> Column:
    """The digest of a row's fields in their order, as bytes."""
    parts = []
    for c in FIELDS:
        x = values.get(c, F.col(c)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, tree, leaf, tampered (the leaf after what `tampered` makes of the text; null where that is the same).

    tree: a name for the source that is never null or empty and orders as sources do, null first.
    """
    tree = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source").cast("string")))
    other = F.lit(None).cast("binary") if tampered is None else F.when(~F.col("text").eqNullSafe(tampered), leaf({"text": tampered}))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), tree.alias("tree"), leaf({}).alias("leaf"), other.alias("tampered"))


def step(nodes: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """The parents of consecutive nodes, and each node's level of its path: its place in the run, the others' number and digests."""
    parents, paths = [], []
    for i in range(0, len(nodes), FAN):
        run = nodes[i : i + FAN]
        parents.append(digest(run))
        paths += [bytes((k, len(run) - 1)) + b"".join(run[:k] + run[k + 1 :]) for k in range(len(run))]
    return parents, paths


def reduced(nodes: list[bytes], levels: int | None = None) -> tuple[bytes, list[bytes]]:
    """The node that is left after so many levels (None: as many as it takes), and each node's path to it."""
    height, at = [], nodes
    while len(at) > 1 if levels is None else len(height) < levels:
        at, paths = step(at)
        height.append(paths)
    way = [b""]
    for paths in reversed(height):
        way = [p + way[i // FAN] for i, p in enumerate(paths)]
    return at[0], way


def siblings(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """The levels of a path: the place of the node in its run, and the digests of the others."""
    i = 0
    while i < len(path):
        at, n = path[i], path[i + 1]
        yield at, [path[j : j + 32] for j in range(i + 2, i + 2 + 32 * n, 32)]
        i += 2 + 32 * n


def fold(node: bytes, path: bytes) -> bytes:
    """The root that a node and its path give."""
    for at, others in siblings(path):
        node = digest([*others[:at], node, *others[at:]])
    return node


def proof_digest(path: bytes) -> bytes:
    return digest([x for _, others in siblings(path) for x in others])


def blocks(nodes: DataFrame, counts: DataFrame, height: int) -> DataFrame:
    """nodes (tree, place, digest and others) with block, path (inside the block) and made (the block's node), written.

    counts: the nodes of each tree (n). A tree of one block is reduced to its root, blocks of others by `height` levels.
    """
    size = FAN**height
    few = counts.count() <= TOP
    rows = nodes.join(F.broadcast(counts) if few else counts, "tree").withColumn("block", F.floor(F.col("place") / size))
    fields = [T.StructField(f.name, f.dataType, True) for f in rows.schema.fields]
    schema = T.StructType([*fields, T.StructField("path", T.BinaryType()), T.StructField("made", T.BinaryType())])

    def close(rows: pa.RecordBatch, cuts: list[int]) -> pa.RecordBatch:
        values, n, paths, made = rows.column("digest").to_pylist(), rows.column("n").to_pylist(), [], []
        for a, b in zip(cuts[:-1], cuts[1:]):
            root, way = reduced(values[a:b], None if n[a] <= size else height)
            paths += way
            made += [root] * (b - a)
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(paths, pa.binary()), pa.array(made, pa.binary())], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            rows = pa.Table.from_batches([*held, batch]).combine_chunks()
            if not rows.num_rows:
                continue
            rows = rows.to_batches()[0]
            keys = list(zip(rows.column("tree").to_pylist(), rows.column("block").to_pylist()))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1])]
            if len(cuts) > 1:
                yield close(rows.slice(0, cuts[-1]), cuts)
            held = [rows.slice(cuts[-1])]
        if held and held[0].num_rows:
            yield close(held[0], [0, held[0].num_rows])

    dealt = bounded(rows).repartition("tree", "block").sortWithinPartitions("tree", "block", "place")
    return stage(dealt.mapInArrow(run, schema), "merkle-blocks")


def _counts(nodes: DataFrame) -> DataFrame:
    return stage(nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), "merkle-counts")


def _next(done: DataFrame, height: int) -> DataFrame:
    """The forest of the blocks' nodes."""
    firsts = done.filter(F.col("place") % FAN**height == 0)
    return stage(firsts.select("tree", F.col("block").alias("place"), F.col("made").alias("digest")), "merkle-forest")


def _on_driver(spark: SparkSession, nodes: list, over: bool) -> DataFrame:
    """tree, place, suffix, subroot, root of the given nodes, built here; over: the trees' roots are joined by one more tree."""
    trees: dict[str, list[bytes]] = {}
    for r in sorted(nodes, key=lambda r: (r.tree.encode(), r.place)):
        trees.setdefault(r.tree, []).append(bytes(r.digest))
    done = {t: reduced(x) for t, x in trees.items()}
    root, ways = reduced([x for x, _ in done.values()]) if over and done else (None, [b""] * len(done))
    rows = [(t, i, p + last, sub, root if over else sub) for (t, (sub, way)), last in zip(done.items(), ways) for i, p in enumerate(way)]
    return spark.createDataFrame(rows, "tree string, place bigint, suffix binary, subroot binary, root binary")


def suffixes(nodes: DataFrame, counts: DataFrame, height: int, top: int, over: bool = True) -> tuple[DataFrame, bool]:
    """For each node (tree, place) its suffix path to the root, the root of its tree and the whole root; whether few enough to send."""
    spark = nodes.sparkSession
    first = nodes.select("tree", "place", "digest").limit(top + 1).collect()
    if len(first) <= top:
        return _on_driver(spark, first, over), True
    if over and counts.filter("n > 1").isEmpty():  # a node for each source, and too many of them: one tree whose nodes are the subroots
        ranked = within_keys(nodes.select(F.lit(SOURCES).alias("one"), "tree", "digest"), "one", ["tree"], "merkle-sources")
        upper = ranked.select(F.lit(SOURCES).alias("tree"), "place", "digest", F.col("tree").alias("source"))
        total = _counts(upper)
        found, small = suffixes(upper, total, height, top, over=False)
        joined = upper.join(F.broadcast(found.drop("tree")) if small else found.drop("tree"), "place")
        return stage(joined.select(F.col("source").alias("tree"), F.lit(0).cast("bigint").alias("place"), "suffix", F.col("digest").alias("subroot"), "root"), "merkle-suffixes"), False
    done = blocks(nodes.select("tree", "place", "digest"), counts, height)
    forest = _next(done, height)
    found, small = suffixes(forest, _counts(forest), height, top, over)
    found = found.withColumnRenamed("place", "block")
    joined = done.join(F.broadcast(found) if small else found, ["tree", "block"])
    return stage(joined.select("tree", "place", F.concat("path", "suffix").alias("suffix"), "subroot", "root"), "merkle-suffixes"), False


def manifest(docs: DataFrame, tampered: Column | None = None, height: int = HEIGHT, top: int = TOP) -> DataFrame:
    """A row for each row of docs: doc_id, leaf, subroot, root, proof, folded (digests as bytes; proof is the path), verified.

    tampered: what has become of the text; folded is the root that the leaf of that text and the row's proof give.
    """
    rows = stage(leaves(docs, tampered), "merkle-leaves")
    placed = within_keys(rows, "tree", ["doc_id", "leaf"], "merkle-places").withColumnRenamed("leaf", "digest")
    done = blocks(placed, _counts(rows), height)
    forest = _next(done, height)
    found, small = suffixes(forest, _counts(forest), height, top)
    found = found.withColumnRenamed("place", "block")
    joined = done.join(F.broadcast(found) if small else found, ["tree", "block"])
    joined = joined.select("doc_id", F.col("digest").alias("leaf"), "tampered", "subroot", "root", F.concat("path", "suffix").alias("proof"))
    schema = "doc_id bigint, leaf binary, subroot binary, root binary, proof binary, folded binary, verified boolean"

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = {c: batch.column(c) for c in batch.schema.names}
            now = [a if b is None else b for a, b in zip(x["leaf"].to_pylist(), x["tampered"].to_pylist())]
            folded = [fold(a, p) for a, p in zip(now, x["proof"].to_pylist())]
            verified = pa.array([a == r for a, r in zip(folded, x["root"].to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([x["doc_id"], x["leaf"], x["subroot"], x["root"], x["proof"], pa.array(folded, pa.binary()), verified], ["doc_id", "leaf", "subroot", "root", "proof", "folded", "verified"])

    return bounded(joined).mapInArrow(finish, schema)


def without_breaks() -> Column:
    """The text without its line breaks where 2 divides the crc32 of the id, else as it is."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit(""))).otherwise(F.col("text").cast("string"))


def digests(docs: DataFrame, height: int = HEIGHT, top: int = TOP) -> DataFrame:
    """The manifest of docs held against texts whose line breaks are gone: all digests as hexadecimal text, and that of the proofs."""
    made = manifest(docs, without_breaks(), height, top)
    schema = "doc_id bigint, leaf binary, subroot binary, root binary, proof binary, folded binary, verified boolean, proof_sha256 binary"

    def proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([proof_digest(p) for p in batch.column("proof").to_pylist()], pa.binary())], [*batch.schema.names, "proof_sha256"])

    shown = lambda c, name=None: F.lower(F.hex(c)).alias(name or c)
    out = bounded(made).mapInArrow(proofs, schema)
    return out.select("doc_id", shown("leaf"), shown("subroot"), shown("root"), shown("proof_sha256"), shown("folded", "folded_root"), "verified")


_CRC32 = """xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(cast({0} as varchar), ''),
    lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: case when x >= 0 then xor(a, x) when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end), 4294967295)"""


def crc32_sql(column: str) -> str:
    """DuckDB's expression for the unsigned crc32 of a column's digits: bit by bit, as it has no function for that."""
    return _CRC32.format(column)


def _leaf_sql(text: str) -> str:
    sized = [f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in ("cast(doc_id as varchar)", "source", "lang", "cast(n_chars as varchar)", text)]
    return f"sha256({' || '.join(sized)})"


_RUN = "string_agg(case when l.idx = f.idx then f.digest else l.digest end, '' order by l.idx)"
_OTHERS = "coalesce(string_agg(l.digest, '' order by l.idx) filter (where l.idx <> f.idx), '')"
SQL = f"""
with recursive
d as (select doc_id, case when source is null then '0' else '1' || source end as tree, {_leaf_sql('text')} as leaf,
    case when {crc32_sql('doc_id')} % 2 = 0 then {_leaf_sql("replace(text, chr(10), '')")} else {_leaf_sql('text')} end as now from documents),
leaves as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by tree) as n from d),
lv as (
  select 0 as lvl, tree, idx, leaf as digest, n from leaves
  union all
  select lvl + 1, tree, idx // 3, sha256(string_agg(digest, '' order by idx)), (any_value(n) + 2) // 3 from lv where n > 1 group by lvl, tree, idx // 3),
subs as (select tree, digest, row_number() over (order by tree) - 1 as idx, count(*) over () as n from lv where n = 1),
up as (
  select 0 as lvl, idx, digest, n from subs
  union all
  select lvl + 1, idx // 3, sha256(string_agg(digest, '' order by idx)), (any_value(n) + 2) // 3 from up where n > 1 group by lvl, idx // 3),
way as (
  select tree, idx as row, 0 as lvl, idx, now as digest, '' as sib from leaves
  union all
  select f.tree, f.row, f.lvl + 1, f.idx // 3, sha256({_RUN}), any_value(f.sib) || {_OTHERS}
  from way f join lv l on l.tree = f.tree and l.lvl = f.lvl and l.idx // 3 = f.idx // 3 where l.n > 1 group by f.tree, f.row, f.lvl, f.idx),
mid as (select w.tree, w.row, s.idx, w.digest, w.sib, s.digest as subroot from way w join lv on lv.tree = w.tree and lv.lvl = w.lvl and lv.n = 1 join subs s on s.tree = w.tree),
upper_way as (
  select tree, row, 0 as lvl, idx, digest, sib, subroot from mid
  union all
  select f.tree, f.row, f.lvl + 1, f.idx // 3, sha256({_RUN}), any_value(f.sib) || {_OTHERS}, any_value(f.subroot)
  from upper_way f join up l on l.lvl = f.lvl and l.idx // 3 = f.idx // 3 where l.n > 1 group by f.tree, f.row, f.lvl, f.idx)
select x.doc_id, x.leaf, w.subroot, u.digest as root, sha256(w.sib) as proof_sha256, w.digest as folded_root, w.digest = u.digest as verified
from upper_way w join up u on u.lvl = w.lvl and u.n = 1 join leaves x on x.tree = w.tree and x.idx = w.row
"""
