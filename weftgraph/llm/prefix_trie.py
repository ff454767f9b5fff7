"""The trie of conversation prefixes, rolled up by pointer jumping.

Turns get their place in their conversation without a task that holds a conversation (`ordered.py`). A prefix's digest is a
sum by remainder, in LANES lanes of 32 bits, of digests of its turns, each taken with its depth; so prefixes are running sums, and
the digest of a prefix's parent is the same less its last turn's. Rows of equal digest are a node; parent edges are keyed by digest.

Sums over subtrees take log2(depth) rounds. In round r each node knows its ancestor 2^r above and the sums of what is less
than 2^r below it; it adds its sums to that ancestor's (combined before the shuffle), and takes over that ancestor's ancestor.

Cases: null roles and texts are empty; turns of conversation null belong to none and are left out; turns that tie are ordered by
role and text; repeated rows are repeated turns; a long text is digested whole, by Spark's own function; other columns
are not read, whatever their names; without conversations there is no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.batches import bounded
from weftgraph.llm.merkle import crc32_sql
from weftgraph.ordered import MODULUS, within_keys
from weftgraph.stage import stage

LANES = 4
ROOT = "0" * 8 * LANES
#: Conversations that share a base, the most turns taken from it (less one), and ids that are digested at a time.
SHARE, HEADS, CHUNK = 20, 4, 4096
NONE_SHA256 = hashlib.sha256(b"").hexdigest()
_SUMS = tuple(f"sum{i}" for i in range(LANES))
_TERMS = tuple(f"term{i}" for i in range(LANES))


def _lanes(digest: Column) -> list[Column]:
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(LANES)]


def _key(lanes: list[Column]) -> Column:
    return F.concat(*(F.lpad(F.lower(F.hex(x)), 8, "0") for x in lanes))


def placed_turns(turns: DataFrame) -> DataFrame:
    """conv_id, place, mark (a digest of role and text), words of each turn; place is from 0."""
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))).filter("conv_id is not null")
    mark = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("mark")
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words")
    tied = rows.groupBy("conv_id", "turn").count().filter("count > 1").select("conv_id", F.col("turn").alias("tie"), F.lit(True).alias("tied"))
    if tied.isEmpty():  # texts order ties alone, so they needn't travel
        rows = rows.select("conv_id", "turn", "role", F.lit("").alias("text"), mark, words)
    else:
        rows = rows.join(tied.withColumnRenamed("conv_id", "c"), (F.col("conv_id") == F.col("c")) & F.col("turn").eqNullSafe(F.col("tie")), "left")
        rows = rows.select("conv_id", "turn", "role", F.when(F.col("tied"), F.col("text")).otherwise(F.lit("")).alias("text"), mark, words)
    return within_keys(stage(rows, "trie-turns"), "conv_id", ["turn", "role", "text"], "trie-places").select("conv_id", "place", "mark", "words")


def shared_heads(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt with first turns of another, and the length of each (conv_id, length).

    Conversation c gets the first h turns of c - c % SHARE in place of its own first h; h is the crc32 of its id % HEADS.
    """
    whole = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = whole.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % SHARE).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("h"))
    bases = whole.filter(F.col("conv_id") % SHARE == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    got = F.least("h", F.coalesce("base_n", F.lit(0).cast("bigint")))
    convs = stage(convs.join(bases, "base", "left").select("conv_id", "base", "h", got.alias("got"), (got + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "trie-convs")
    first = own.filter((F.col("conv_id") % SHARE == 0) & (F.col("place") < HEADS - 1)).withColumnRenamed("conv_id", "base")
    given = convs.join(first, "base").filter("place < h").select("conv_id", (F.col("place") + 1).alias("depth"), "mark", "words", "length")
    kept = own.join(convs, "conv_id").filter("place >= h").select("conv_id", (F.col("place") - F.col("h") + F.col("got") + 1).alias("depth"), "mark", "words", "length")
    return given.unionByName(kept), convs.select("conv_id", "length")


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """conv_id, depth, words, last (nothing follows), key, parent for each prefix of each conversation but the empty one."""
    digest = F.sha2(F.concat(F.col("depth").cast("string").cast("binary"), F.lit(b":"), "mark"), 256)
    rows = rebuilt.select("conv_id", "depth", "words", (F.col("depth") == F.col("length")).alias("last"), digest.alias("digest"))
    lanes = _lanes(F.col("digest"))
    rows = rows.select("conv_id", "depth", "words", "last", *(x.alias(t) for x, t in zip(lanes, _TERMS)), *(x.alias(s) for x, s in zip(lanes, _SUMS)))
    rows = within_keys(rows, "conv_id", ["depth"], "trie-prefixes", _SUMS)
    parent = _key([F.pmod(F.col(s) - F.col(t), F.lit(MODULUS)) for s, t in zip(_SUMS, _TERMS)])
    return rows.select("conv_id", "depth", "words", "last", _key([F.col(s) for s in _SUMS]).alias("key"), parent.alias("parent"))


def id_digests(ends: DataFrame) -> DataFrame:
    """key, ends_sha256: the digest of all conv_ids of a key, ascending and joined by commas.

    Ids are joined CHUNK at a time wherever they are; one task then digests a key's chunks as they stream by.
    """
    placed = within_keys(ends, "key", ["conv_id"], "trie-ends")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    chunks = placed.groupBy("key", F.floor(F.col("place") / CHUNK).alias("chunk")).agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, done = None, None, []
        for batch in batches:
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if k != key:
                    if key is not None:
                        done.append((key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], ["key", "ends_sha256"])
                done = []
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([sha.hexdigest()])], ["key", "ends_sha256"])

    return bounded(chunks).repartition("key").sortWithinPartitions("key", "chunk").select("key", "ids").mapInArrow(run, "key string, ends_sha256 string")


def rolled_up(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """nodes (key, parent, depth; the root's parent is null, its depth 0) with each column of sums summed over the node's subtree.

    As many rounds as the depth has binary digits.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    columns, reach = nodes.columns, 1
    state = stage(nodes.withColumn("jump", F.col("parent")), "trie-round")
    while reach <= deepest:
        below = state.filter("jump is not null").groupBy(F.col("jump").alias("target")).agg(*(F.sum(s).alias(f"more_{s}") for s in sums))
        grown = state.join(below, F.col("key") == F.col("target"), "left").withColumns({s: F.col(s) + F.coalesce(f"more_{s}", F.lit(0)) for s in sums}).select(*columns, "jump")
        over = state.select(F.col("key").alias("jump"), F.col("jump").alias("next"))
        # a node at depth 2 * reach lands on the root, those above it nowhere: only the deeper ones ask
        far = grown.filter(F.col("depth") > 2 * reach).join(over, "jump").select(*columns, F.col("next").alias("jump"))
        near = grown.filter(F.col("depth") <= 2 * reach).withColumn("jump", F.when(F.col("depth") == 2 * reach, F.lit(ROOT)))
        state = stage(far.unionByName(near), "trie-round")
        reach *= 2
    return state.select(*columns)


def trie(rebuilt: DataFrame, lengths: DataFrame) -> DataFrame:
    """A row for each node of the trie of rebuilt (conv_id, depth, mark, words, length), the root included.

    Columns: key, parent (digests), conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. lengths has all conversations, those without turns too.
    """
    rows = stage(prefixes(rebuilt), "trie-keys")
    made = rows.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"))
    root = lengths.groupBy(F.lit(ROOT).alias("key")).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    root = root.withColumns({"depth": F.lit(0).cast("bigint"), "parent": F.lit(None).cast("string"), "words": F.lit(0).cast("bigint")})
    nodes = stage(made.unionByName(root), "trie-nodes")
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    none = F.lit(0).cast("bigint")
    counted = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", none))
    counted = counted.withColumns({"n_leaves": (F.col("n_children") == 0).cast("bigint"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")})
    summed = rolled_up(counted.drop("words"), ["n_leaves", "saved_tokens"])
    ends = rows.filter("last").select("key", "conv_id").unionByName(lengths.filter("length = 0").select(F.lit(ROOT).alias("key"), "conv_id"))
    summed = summed.join(id_digests(ends), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NONE_SHA256)))
    top = nodes.filter("depth = 0").first()
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    low = summed.filter("depth > 1").join(above, "parent")
    high = summed.filter("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(top.conv_id if top else None).cast("bigint")))
    names = ["key", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return low.select(*names).unionByName(high.select(*names))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie of conversations that are rebuilt with shared heads."""
    own = placed_turns(turns)
    return trie(*shared_heads(own))


SQL = f"""
with own as (
  select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as place
  from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)),
convs as (select conv_id, conv_id - conv_id % {SHARE} as base, {crc32_sql('conv_id')} % {HEADS} as h, count(*) as n from own group by conv_id),
t as (
  select c.conv_id, o.place + 1 as depth, o.role, o.text from convs c join own o on o.conv_id = c.base and o.place < c.h
  union all
  select c.conv_id, o.place - c.h + least(c.h, coalesce(b.n, 0)) + 1, o.role, o.text
  from convs c join own o on o.conv_id = c.conv_id and o.place >= c.h left join convs b on b.conv_id = c.base),
p as (
  select conv_id, depth, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) as words,
    sha256(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') over (partition by conv_id order by depth)) as k from t
  union all select conv_id, 0, 0, '' from convs),
o as (select *, depth = max(depth) over (partition by conv_id) as last from p),
nodes as (
  select k, min(depth) as depth, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * max(words) as saved,
    sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where last), '')) as ends_sha256 from o group by k),
edges as (select n.k, a.k as parent from nodes n join o a on a.conv_id = n.conv_id and a.depth = n.depth - 1),
kids as (select parent as k, count(*) as n_children from edges group by parent),
whole as (
  select a.k, sum(case when c.n_children is null then 1 else 0 end) as n_leaves, sum(n.saved) as saved_tokens
  from nodes n left join kids c on c.k = n.k join o a on a.conv_id = n.conv_id and a.depth <= n.depth group by a.k)
select n.conv_id, cast(n.depth as bigint) as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(c.n_children, 0) as n_children,
  cast(w.n_leaves as bigint) as n_leaves, cast(w.saved_tokens as bigint) as saved_tokens, n.ends_sha256
from nodes n join whole w on w.k = n.k left join kids c on c.k = n.k left join edges e on e.k = n.k left join nodes p on p.k = e.parent
"""
