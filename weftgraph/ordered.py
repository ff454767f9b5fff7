"""Places and running sums of rows within groups of any size, without a task that holds a group.

Rows are dealt by ranges of (key, order), so a large group is spread over many tasks, in order. A task numbers and sums what it
has of each key; only the first key of a task can have begun in an earlier one, so a summary row of each task tells what to add.
The driver gets these summaries: one a task, whatever the rows and keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.batches import bounded
from weftgraph.stage import stage

#: Running sums are kept by remainder, so they never overflow: 32-bit numbers by this one, sums that must be whole by a larger one.
MODULUS = 1 << 32


def within_keys(rows: DataFrame, key: str, order: list[str], name: str, sums: tuple[str, ...] = (), modulus: int = MODULUS) -> DataFrame:
    """rows (written) with `place`, from 0 among the rows of a key, and each column of sums as its running sum by remainder.

    key must not be null; nulls of order come first. Rows that tie in all of order may get each other's places.
    """
    fields = [T.StructField(f.name, f.dataType, True) for f in rows.schema.fields]
    schema = T.StructType([*fields, T.StructField("place", T.LongType()), T.StructField("opens", T.BooleanType()), T.StructField("task", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, carried, opening = None, 0, np.zeros(len(sums), np.int64), True
        for batch in batches:
            keys, m = batch.column(key), batch.num_rows
            if not m:
                continue
            new = np.zeros(m, bool)
            new[0] = last is not None and keys[0].as_py() != last
            new[1:] = np.asarray(pc.not_equal(keys[1:], keys[:-1]))
            begin = np.flatnonzero(new)
            run_of = np.cumsum(new)
            start = np.concatenate(([-n], begin))[run_of]
            place = np.arange(m) - start
            opens = (run_of == 0) & opening
            columns = dict(zip(batch.schema.names, batch.columns))
            task = columns.pop("task")
            for i, s in enumerate(sums):
                total = np.cumsum(np.asarray(columns[s], np.int64))
                before = np.concatenate(([-carried[i]], total[begin - 1] if len(begin) else []))
                if len(begin) and begin[0] == 0:
                    before[1] = 0
                running = (total - before[run_of].astype(np.int64)) % modulus
                columns[s], carried[i] = pa.array(running), running[-1]
            last, n = keys[m - 1].as_py(), int(place[-1]) + 1
            opening = bool(opens[-1])
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(place), pa.array(opens), task], schema.names)

    dealt = bounded(rows).repartitionByRange(F.col(key), *(F.col(c) for c in order)).sortWithinPartitions(key, *order).withColumn("task", F.spark_partition_id())
    made = stage(dealt.mapInArrow(run, schema), name)
    ends = made.groupBy("task").agg(F.min(key).alias("first"), F.max_by(F.struct(F.col(key).alias("key"), "place", *sums), F.struct(key, "place")).alias("last")).collect()
    return _carried(made, sorted(ends, key=lambda r: r.task), sums, modulus)


def _carried(made: DataFrame, ends: list, sums: tuple[str, ...], modulus: int) -> DataFrame:
    """made with what earlier tasks had of the first key of each task added to that key's rows."""
    spark: SparkSession = made.sparkSession
    key, n, total, add = None, 0, [0] * len(sums), []
    for r in ends:
        if r.first != key:
            n, total = 0, [0] * len(sums)
        elif n:
            add.append((r.task, n, *total))
        if r.last.key != r.first:
            n, total = 0, [0] * len(sums)
        key, n, total = r.last.key, n + r.last.place + 1, [(a + r.last[s]) % modulus for a, s in zip(total, sums)]
    if not add:
        return made.drop("opens", "task")
    carry = spark.createDataFrame(add, ", ".join(["task int", "carry bigint", *(f"carry_{i} bigint" for i in range(len(sums)))]))
    out = made.join(F.broadcast(carry), "task", "left")
    more = lambda c: F.when(F.col("opens"), F.coalesce(F.col(c), F.lit(0))).otherwise(0)
    summed = {s: F.pmod(F.col(s) + more(f"carry_{i}"), F.lit(modulus)) for i, s in enumerate(sums)}
    return out.withColumns({"place": F.col("place") + more("carry"), **summed}).select(*[c for c in made.columns if c not in ("opens", "task")])
