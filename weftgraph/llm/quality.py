"""Quality: random-indexing word vectors pooled per document, then a two-layer network with calibrated probabilities.

Each word (a run of letters and digits, or of other signs, as written) has a fixed sparse index vector of signs, drawn from
its 64-bit hash. Its context vector is the sum of the index vectors of its neighbours in all documents; context vectors
have 2^18 places, dealt to words by hash. Tasks sum their share and send what isn't zero, compressed, by blocks of places;
a reduction tree sums a bounded number of shares in each of its nodes. A document is the mean of its words' normed context
vectors and of their index vectors, with the lengths of both means and its number of words. The network learns from a
bounded sample of labelled documents; one part of it sets the temperature that calibrates.

Cases: a null text is empty; an empty text is a document of zeros and gets a score; a long text is pooled whole; with no
labelled rows of both kinds every score is 1; rows that repeat are scored each, and train once; of two labels of one id the
larger counts; a score of exactly THRESHOLD is good; other columns are not read, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.batches import bounded
from weftgraph.llm.labelled import append, fold, labelled_sample
from weftgraph.llm.packed import pack, unpack
from weftgraph.llm.words import LETTERS_OR_SIGNS, mix, words

BITS, DIM, SIGNS = 18, 32, 4
#: Blocks of places, and shares that a node of the reduction tree sums.
BLOCKS, FAN_IN = 64, 256
#: The most labelled rows that training reads; each is 2 * DIM + 3 numbers.
TRAIN_ROWS = 10_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 32, 60, 128, 3e-3, 1e-4, 11
THRESHOLD = 0.3
WIDTH = 2 * DIM + 3


def index_vectors(hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each sign of an index vector its place in the vectors of words, and the sign (1 or -1)."""
    h = mix(hashes ^ np.uint64(0x51ED270B7A1F39C5))
    out = []
    for k in range(SIGNS):
        part = (h >> np.uint64(8 * k)).astype(np.int64)
        out.append((part % DIM, 1 - 2 * (part // DIM & 1)))
    return out


def entries(column) -> Iterator[tuple[object, np.ndarray]]:
    """Slices of words, and their hashes."""
    for w in words(column, LETTERS_OR_SIGNS):
        yield w, w.hashes()


def place(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def _shares(sums: np.ndarray, part: int) -> pa.RecordBatch:
    """What isn't zero of a table of sums, by block."""
    rows = []
    for block, x in enumerate(sums.reshape(BLOCKS, -1)):
        at = np.flatnonzero(x)
        if len(at):
            rows.append((block, part, pack(np.diff(at, prepend=0)), pack(x[at])))
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["block", "part", "at", "sums"])


def context_vectors(docs: DataFrame) -> np.ndarray:
    """The sums of neighbours' index vectors over all documents, for each place: 2^18 by 32 numbers, whatever the input."""
    size = (DIM << BITS) // BLOCKS

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIM << BITS, np.int64)
        for batch in batches:
            for w, h in entries(batch.column("text")):
                row, e, index = w.rows(), place(h) * DIM, index_vectors(h)
                near = np.flatnonzero(row[1:] == row[:-1])
                for word, other in ((near, near + 1), (near + 1, near)):
                    for at, sign in index:
                        np.add.at(total, e[word] + at[other], sign[other])
        yield _shares(total, TaskContext.get().partitionId())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for block, part, at, x in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "at", "sums"))):
                have = sums.setdefault((block, part), np.zeros(size, np.int64))
                have[np.cumsum(unpack(at), dtype=np.int64)] += unpack(x)
        for (block, part), x in sums.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int64()), pa.array([pack(np.diff(at, prepend=0))], pa.binary()), pa.array([pack(x[at])], pa.binary())], ["block", "part", "at", "sums"])

    schema = "block int, part bigint, at binary, sums binary"
    rows = bounded(docs).select("text").mapInArrow(task, schema)
    shares = rows.rdd.getNumPartitions()
    while True:
        shares = math.ceil(shares / FAN_IN)
        rows = rows.withColumn("part", F.floor(F.col("part") / FAN_IN)).repartition("block", "part").mapInArrow(add, schema)
        if shares <= 1:
            break
    out = np.zeros((BLOCKS, size))
    for r in rows.toLocalIterator():
        out[r.block][np.cumsum(unpack(r["at"]), dtype=np.int64)] = unpack(r["sums"])
    return out.reshape(1 << BITS, DIM)


def word_table(context: np.ndarray) -> np.ndarray:
    """For each place its normed context vector."""
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    return (context / np.maximum(norm, 1e-9)).astype(np.float32)


def pooled(column, table: np.ndarray) -> np.ndarray:
    """A row of 2 * DIM + 3 numbers for each text."""
    out = []
    for w, h in entries(column):
        n = w.counts()
        mean = np.zeros((len(n), 2 * DIM), np.float64)
        full = np.flatnonzero(n)
        if len(full):
            mean[full, :DIM] = np.add.reduceat(table[place(h)], w.ptr[:-1][full], axis=0, dtype=np.float64)
            row = w.rows()
            for at, sign in index_vectors(h):
                mean[:, DIM:] += np.bincount(row * DIM + at, sign, minlength=len(n) * DIM).reshape(len(n), DIM)
            mean[full] /= n[full, None]
        out.append(np.column_stack([mean, np.linalg.norm(mean[:, :DIM], axis=1), np.linalg.norm(mean[:, DIM:], axis=1), np.log1p(n)]))
    return np.concatenate(out) if out else np.zeros((0, WIDTH))


@dataclass(frozen=True)
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def gradients(p: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean log loss and the weight decay, by w1, b1, w2 and b2."""
    h = np.tanh(x @ p[0] + p[1])
    d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -50, 50))) - y) / len(y)
    dh = np.outer(d, p[2]) * (1 - h * h)
    return [x.T @ dh + DECAY * p[0], dh.sum(0), h.T @ d + DECAY * p[2], np.array([d.sum()])]


def temperature_of(logits: np.ndarray, truth: np.ndarray) -> float:
    """Of 81 temperatures between exp(-1.5) and exp(2.5) the one with the least log loss."""
    heat = np.exp(np.linspace(-1.5, 2.5, 81))
    return float(min(heat, key=lambda t: float(np.mean(np.logaddexp(0, logits / t) - truth * logits / t)) if len(logits) else 0.0))


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    """Trains by Adam on four fifths of the rows, and sets the temperature on the last fifth."""
    if len(set(y.tolist())) < 2:
        return Network(np.zeros(WIDTH), np.ones(WIDTH), np.zeros((WIDTH, 1)), np.zeros(1), np.zeros(1), 50.0, 1.0)
    rng = np.random.default_rng(SEED)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    s, cut = (x - mean) / scale, max(1, len(x) * 4 // 5)
    p = [rng.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(EPOCHS):
        order, rate = rng.permutation(cut), RATE * (1 - epoch / EPOCHS)
        for i in range(0, cut, BATCH):
            t += 1
            for k, g in enumerate(gradients(p, s[order[i : i + BATCH]], y[order[i : i + BATCH]])):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    return replace(net, temperature=temperature_of(net.logits(x[cut:]), y[cut:]))


def train(docs: DataFrame, labels: DataFrame, table: Callable[[], np.ndarray], label: str = "quality", most: int = TRAIN_ROWS) -> Network:
    def made(batch: pa.RecordBatch) -> pa.Array:
        return pa.array([r.astype(np.float32).tobytes() for r in pooled(batch.column("text"), table())], pa.binary())

    rows, truth = labelled_sample(docs, labels, label, most, made, most * WIDTH * 4)
    x = np.array([np.frombuffer(r, np.float32) for r in rows], np.float64).reshape(-1, WIDTH)
    return fit(x, truth.astype(np.float64))


def score_documents(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(word_table(context_vectors(docs)))  # 32 MB, whatever the input
    net = train(docs, labels, lambda: sent.value, most=most)
    out, name = append(docs.select("doc_id", "text"), "quality", T.DoubleType(), lambda b: pa.array(net.probability(pooled(b.column("text"), sent.value)), pa.float64()))
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col(name).alias("score"), (F.col(name) >= THRESHOLD).cast("int").alias("predicted"))
