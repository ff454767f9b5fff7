"""Bounded samples of labelled rows, and columns that Python adds to documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.batches import bounded
from weftgraph.llm.words import text_slices
from weftgraph.stage import stage

#: Folds of doc_id; fold 0 is held out.
FOLDS = 5


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    """crc32 of the id as text, by remainder; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, made: Callable[[pa.RecordBatch], pa.Array], most_bytes: int) -> tuple[list[bytes], np.ndarray]:
    """What `made` (binary) makes of the texts of a bounded sample of labelled rows outside the held-out fold, and their labels.

    Rows are taken in the order of a hash of their id, at most `most` rows of docs and `most_bytes` of what is made, the same
    ones each time; both bounds hold for what the driver gets. Rows of docs that agree in id and in what is made count once,
    rows of labels that repeat an id count once with the larger label, and labels without a document count for nothing: the
    first labels are looked for, four times as many if they have too few documents, until enough are found.
    """
    chosen = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    chosen = stage(chosen.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).withColumn("draw", F.xxhash64("doc_id", F.lit(7))), "labelled-ids")
    every, take = chosen.count(), 2 * most
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = ["draw", "doc_id", "label", "mark"]
    while True:
        few = chosen.orderBy("draw", "doc_id").limit(take)
        found = texts.join(F.broadcast(few) if take <= 8 * most else few, "doc_id")  # more than that isn't sent to tasks
        out, name = append(found.select("doc_id", "text", "label", "draw"), "made", T.BinaryType(), made)
        out = out.select("draw", "doc_id", "label", F.xxhash64(name).alias("mark"), F.col(name).alias("made"))
        out = stage(out.groupBy(*key).agg(F.min("made").alias("made")), "labelled-sample")
        first = out.select(*key, F.octet_length("made").alias("size")).orderBy(*key).limit(most).collect()
        if len(first) == most or take >= every:
            break
        take *= 4
    total, last = 0, None
    for r in first:
        total += r["size"]
        if total > most_bytes:
            break
        last = r
    if last is None:
        return [], np.zeros(0, np.int64)
    upto = F.struct(*key) <= F.struct(*(F.lit(last[k]).cast(t) for k, t in zip(key, ("bigint", "bigint", "int", "bigint"))))
    rows = out.filter(upto).toArrow().sort_by([(k, "ascending") for k in key])
    return [x.as_py() for x in rows.column("made")], rows.column("label").to_numpy()


def append(docs: DataFrame, name: str, kind: T.DataType, made: Callable[[pa.RecordBatch], pa.Array], need: tuple[str, ...] = ("text",)) -> tuple[DataFrame, str]:
    """docs with one more column, and its name: `name`, or with underscores after it where docs has that already.

    made gets slices of bounded size and returns a value for each row.
    """
    while name in docs.columns:
        name += "_"
    fields = [*docs.schema.fields, T.StructField(name, kind, True)]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch):
                yield pa.RecordBatch.from_arrays([*piece.columns, made(piece)], names)

    return bounded(docs).mapInArrow(run, schema), name
