"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target of words: its weight's share, at most `most` times its size, the excess shared again by weight
until none is above. Each document of a source should then be taken target / size times. The whole part is taken; the
fractions are rounded by pivots: two documents meet, words move from one to the other at random until the copies of one
are whole, and the other goes on to the next. A pivot keeps the words of the pair, and each document's expected copies,
so a source's words are off its target by less than one document's.

Leaves of a reduction tree (about LEAF of a source's documents, by hash) are rounded one after the other in sorted order; each leaves at
most one fraction, and those meet in the next level, FAN_IN leaves in a node, until a source has one node, whose last
fraction is drawn. Tasks hold one fraction at a time, so neither a hot source nor a hot leaf needs memory.

Draws are hashes of ids, sizes, texts and of the seed, so reruns agree. Cases: a null text has no words, and documents
without words are taken a whole number of times and move nothing; a null source is a source, the last; a null id is an id
like others; rows that repeat count each, and those that agree in id and text meet in one leaf, one at a time; a long text
is counted whole; other columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.stage import stage
from weftgraph.llm.words import mix

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
LEAF, FAN_IN = 1000, 500
SEED = 20260101
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (the number of words in the text), mark (a hash of id and text)."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), F.xxhash64("doc_id", "text").alias("mark"))


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target, docs. Sources are few beside documents, and stay distributed all the same."""
    spark = sized.sparkSession
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    ranked = totals.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(lambda x: (*x[0], float(weights[x[1] % len(weights)])))
    table = stage(spark.createDataFrame(ranked, "source string, source_size bigint, docs bigint, weight double"), "mix-sources")
    everything = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    # raise the level (words a unit of weight gets) until no further source reaches its cap
    cap, level, full = most * F.col("source_size"), 0.0, -1
    while True:
        above = cap <= level * F.col("weight")
        capped, free, n = table.agg(F.sum(F.when(above, cap).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))), F.count_if(above)).first()
        if not free or n == full:
            break
        level, full = (share * everything - capped) / free, n
    target = F.least(cap, F.lit(level) * F.col("weight"))
    return stage(table.select("source", "source_size", target.alias("target"), "docs"), "mix-targets")


_OUT = "source string, node bigint, doc_id bigint, size bigint, mark bigint, base int, extra int, rest double"
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
_NAMES = ["source", "node", "doc_id", "size", "mark", "base", "extra", "rest"]


def draws(marks: np.ndarray, salt: int) -> tuple[list[float], list[float]]:
    """For each row a number from 0 to 1 for its pivot, and another for the case that its fraction is the last one left."""
    h = mix(marks.astype(np.uint64) + np.uint64(salt))
    return tuple(((x >> np.uint64(11)) / 2.0**53).tolist() for x in (h, mix(h ^ np.uint64(0x6A09E667F3BCC909))))


def _rounds(salt: int, last: bool):
    """Rounds rows sorted by (source, node): extra is 0 or 1, or null for a node's one fraction left, then in rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None  # the row whose fraction is open

        def close(out: list, row: dict) -> None:
            if last:
                row["extra"], row["rest"] = int(row["u"] < row["rest"]), None
            out.append(row)

        for batch in batches:
            out: list = []
            for row, draw, end in zip(batch.to_pylist(), *draws(batch.column("mark").to_numpy(), salt)):
                row |= {"extra": None, "u": end}
                size, rest = row["size"], row["rest"]
                if size == 0 or rest <= 0.0 or rest >= 1.0:
                    row["extra"], row["rest"] = int(rest >= 1.0), None
                    out.append(row)
                    continue
                if held is None or (held["source"], held["node"]) != (row["source"], row["node"]):
                    if held is not None:
                        close(out, held)
                    held = row
                    continue
                p, s = held["rest"], held["size"]
                up, down = min((1 - p) * s, rest * size), min(p * s, (1 - rest) * size)
                if draw * (up + down) < down:  # the held one gains `up` words
                    whole_held, whole_row = (1 - p) * s <= rest * size, rest * size <= (1 - p) * s
                    p, rest = (1.0 if whole_held else p + up / s), (0.0 if whole_row else rest - up / size)
                else:
                    whole_held, whole_row = p * s <= (1 - rest) * size, (1 - rest) * size <= p * s
                    p, rest = (0.0 if whole_held else p - down / s), (1.0 if whole_row else rest + down / size)
                held["rest"], row["rest"] = p, rest
                if whole_held:
                    held["extra"], held["rest"] = int(p), None
                    out.append(held)
                    held = row
                if whole_row:
                    row["extra"], row["rest"] = int(rest), None
                    out.append(row)
                    held = None if held is row else held
            if out:
                yield _made(out)
        if held is not None:
            out = []
            close(out, held)
            yield _made(out)

    return run


def _made(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(_NAMES, _TYPES)], _NAMES)


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, leaf: int = LEAF, fan_in: int = FAN_IN) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, copies, taken."""
    sized = stage(sizes(docs), "mix-sizes")
    targets = source_targets(sized, weights, share, most)
    nodes = math.ceil((targets.agg(F.max("docs")).first()[0] or 1) / leaf)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    join = sized["source"].eqNullSafe(targets["source"])
    node = F.pmod(F.xxhash64("mark", F.lit(seed)), F.lit(nodes))
    rows = sized.join(targets, join).select(sized["source"], node.alias("node"), "doc_id", "size", "mark", F.floor(ratio).cast("int").alias("base"), (ratio - F.floor(ratio)).alias("rest"))
    done, level = None, 0
    while True:
        run = _rounds((seed * 1_000_003 + level) & (2**63 - 1), nodes == 1)
        made = stage(rows.repartition("source", "node").sortWithinPartitions("source", "node", "mark", "size").mapInArrow(run, _OUT), f"mix-level{level}")
        whole = made.filter("extra is not null")
        done = whole if done is None else done.unionByName(whole)
        if nodes == 1:
            break
        nodes, level = math.ceil(nodes / fan_in), level + 1
        rows = made.filter("extra is null").select("source", F.pmod(F.col("node"), F.lit(nodes)).alias("node"), "doc_id", "size", "mark", "base", "rest")
    copies = (F.col("base") + F.col("extra")).cast("bigint")
    join = done["source"].eqNullSafe(targets["source"])
    return done.join(targets, join).select("doc_id", done["source"], "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
