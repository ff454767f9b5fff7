"""Sums of tables of whole numbers that each task counts, through a reduction tree."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.batches import bounded
from weftgraph.llm.packed import pack, unpack

BLOCKS, FAN_IN = 64, 256
_SCHEMA = "block int, part bigint, at binary, sums binary"


def _packed(block: int, part: int, sums: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(sums)
    cells = ([block], pa.int32()), ([part], pa.int64()), ([pack(np.diff(at, prepend=0))], pa.binary()), ([pack(sums[at])], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in cells], ["block", "part", "at", "sums"])


def _unpacked(at: bytes, sums: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(unpack(at), dtype=np.int64), unpack(sums)


def totals(rows: DataFrame, size: int, count: Callable[[pa.RecordBatch, np.ndarray], None]) -> np.ndarray:
    """A table of `size` numbers (a multiple of BLOCKS), to which count adds what each batch of rows has.

    A task holds one table. What isn't zero goes on compressed, in BLOCKS blocks; a node of the tree sums FAN_IN tasks' blocks
    one by one. Only the last sums reach the driver.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, np.int64)
        for batch in batches:
            count(batch, table)
        for block, x in enumerate(table.reshape(BLOCKS, -1)):
            if x.any():
                yield _packed(block, TaskContext.get().partitionId(), x)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, table = None, np.zeros(size // BLOCKS, np.int64)
        for batch in batches:
            for block, part, at, x in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "at", "sums"))):
                if key != (block, part):
                    if key:
                        yield _packed(*key, table)
                    key, table = (block, part), np.zeros_like(table)
                places, values = _unpacked(at, x)
                table[places] += values
        if key:
            yield _packed(*key, table)

    shared = bounded(rows).mapInArrow(task, _SCHEMA)
    left = shared.rdd.getNumPartitions()
    while True:
        left = math.ceil(left / FAN_IN)
        shared = shared.withColumn("part", F.floor(F.col("part") / FAN_IN)).repartition("block", "part").sortWithinPartitions("block", "part").mapInArrow(add, _SCHEMA)
        if left <= 1:
            break
    out = np.zeros((BLOCKS, size // BLOCKS), np.int64)
    for r in shared.toLocalIterator():
        places, values = _unpacked(r["at"], r["sums"])
        out[r.block][places] = values
    return out.ravel()
