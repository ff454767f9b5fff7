"""Exact duplicates: groups by a 128-bit content hash, bytes compared inside groups. DataFrame functions only.

What is grouped on the hash is combined before the shuffle, so a text that a third of all rows repeat costs each task
one row. Bytes are compared by grouping texts whose hash occurs more than once on (hash, text), likewise combined before the shuffle.

Cases: a null text is an empty text, and all empty texts are equal. Of rows with the same text and the same id one is
kept. A row with a null id stays only where all rows of the text have none. A long text is read whole; its groups hold one
copy a task. Columns other than the id and the text are not read by exact_dedup, whatever their names; keep_one carries
them, maps and variants too. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.stage import stage


#: Hashes that are sent to tasks, 16 bytes each; with more of them all texts are shuffled.
SENT_HASHES = 500_000


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def collided(docs: DataFrame, hashed: Callable[[Column], Column] = content_hash, rows: DataFrame | None = None) -> DataFrame:
    """The hashes (h) that different texts share; rows has the hashes (h) of docs, if they are known.

    Only texts whose hash occurs twice are shuffled, as long as the list of those hashes is small enough to be sent.
    """
    texts = docs.select(hashed(_text()).alias("h"), _text().alias("t"))
    again = stage((texts if rows is None else rows).groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "exact-again")
    if again.count() <= SENT_HASHES:
        texts = texts.join(F.broadcast(again), "h", "left_semi")
    texts = texts.groupBy("h", "t").agg(F.count(F.lit(1)).alias("n"))
    return texts.groupBy("h").agg(F.count(F.lit(1)).alias("variants")).filter("variants > 1").select("h")


def exact_dedup(docs: DataFrame, keep: str = "smallest", hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    keep: whether the row with the smallest or the largest doc_id of a group stays.
    """
    best, lack = {"smallest": (F.min, F.col("doc_id").isNull()), "largest": (F.max, F.col("doc_id").isNotNull())}[keep]

    def judged(rows: DataFrame, key: list[str]) -> DataFrame:
        groups = rows.groupBy(*key).agg(best(F.struct(lack, "doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size"))
        groups = stage(groups.select(*key, F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size"), "exact-groups")
        return rows.join(groups, key).select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")

    row = F.monotonically_increasing_id().alias("row")
    digest = F.sha2(_text(), 256).alias("text_sha256")
    rows = stage(docs.select("doc_id", row, hashed(_text()).alias("h"), digest), "exact-rows")
    shared = stage(collided(docs, hashed, rows), "exact-collided")
    if shared.isEmpty():
        return judged(rows, ["h"])
    apart = docs.select("doc_id", row, hashed(_text()).alias("h"), _text().alias("t"), digest).join(shared, "h", "left_semi")
    apart = stage(apart, "exact-apart")
    return judged(rows.join(shared, "h", "left_anti"), ["h"]).unionByName(judged(apart, ["h", "t"]))


def _orders(kind: T.DataType) -> bool:
    """Whether Spark can order values of a type."""
    if isinstance(kind, T.ArrayType):
        return _orders(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_orders(f.dataType) for f in kind)
    return not isinstance(kind, (T.MapType, T.VariantType, T.CalendarIntervalType))


def keep_one(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of docs that stay, with all their columns: one shuffle, in which equal texts meet as group keys.

    Of rows that tie on doc_id, the one whose other columns are smallest (or largest) stays; columns that have no order
    count as JSON there.
    """
    low = keep == "smallest"
    rest = [f for f in docs.schema if f.name not in ("doc_id", "text")]
    names = [f.name for f in rest]
    gone, lack = "text is null", "no doc_id"
    while gone in names or lack in names:
        gone, lack = gone + "_", lack + "_"
    column = {f.name: F.col(f"`{f.name}`") for f in rest}
    first = [(F.col("doc_id").isNull() if low else F.col("doc_id").isNotNull()).alias(lack), F.col("doc_id"), F.col("text").isNull().alias(gone)]
    row = F.struct(*first, *column.values())
    if all(_orders(f.dataType) for f in rest):
        best = F.min("row") if low else F.max("row")
    else:
        shown = [F.struct(column[f.name].alias(f.name)) if _orders(f.dataType) else F.to_json(F.struct(column[f.name].alias("x"))) for f in rest]
        best = (F.min_by if low else F.max_by)("row", "place")
        first = [*first, *(x.alias(f"c{i}") for i, x in enumerate(shown))]
    keyed = docs.select(content_hash(_text()).alias("h"), _text().alias("t"), row.alias("row"), F.struct(*first).alias("place"))
    groups = keyed.groupBy("h", "t").agg(best.alias("row"))
    text = F.when(~F.col(f"row.`{gone}`"), F.col("t"))
    return groups.select(*(text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


SQL = """
with d as (select doc_id, coalesce(text, '') as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
select d.doc_id, g.keep_id, cast(g.group_size as bigint) as group_size, d.doc_id = g.keep_id as kept, sha256(d.t) as text_sha256
from d join g on d.t = g.t
"""
