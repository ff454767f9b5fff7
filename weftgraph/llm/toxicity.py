"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of words, of their stems (the first bytes of a word), of pairs of neighbouring words and of
pairs with one word between, hashed into 2^22 weights. Training visits a bounded sample of labelled documents one by one;
each weight has its own learning rate, and the L1 term leaves most at zero, so the model that is sent to the tasks is a
short list of indices and weights. Scoring hashes whole texts and sums the weights found.

The sample has at most TRAIN_ROWS documents and TRAIN_BYTES of features (4 bytes each), taken by a hash of the id.

Words are runs of letters and digits in lower case. Cases: a null text is empty; an empty text gets the score of the
bias; a long text is scored whole, and takes part in training if its features fit; with no labelled rows of both kinds
every score is 0; rows that repeat are scored each, and train once; of two labels of one id the larger counts; a score of
exactly THRESHOLD is toxic; other columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.labelled import append, fold, labelled_sample
from weftgraph.llm.words import ALNUM, LOWER, Words, join_hashes, large, mix, words

BITS = 22
STEM_BYTES = 6
#: The most labelled rows that training reads, and the most bytes of their features.
TRAIN_ROWS, TRAIN_BYTES = 8000, 64 << 20
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 8.0, 0.2, 6
THRESHOLD = 0.5


@dataclass(frozen=True)
class Weights:
    """The weights that are not zero, by index, and the bias."""

    index: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.index] = self.weight
        return out


def features(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (counted from w.first) and indices of features, with repeats."""
    h, row = w.hashes(), w.rows()
    stems = mix(w.hashes(STEM_BYTES) + np.uint64(1))
    out = [(row, h), (row, stems)]
    for apart, salt in ((1, 2), (2, 3)):
        if len(h) > apart:
            same = np.flatnonzero(row[apart:] == row[:-apart])
            out.append((row[same], mix(join_hashes(h[:-apart], h[apart:])[same] + np.uint64(salt))))
    return [(r, (x >> np.uint64(64 - BITS)).astype(np.int64)) for r, x in out]


def text_words(column):
    return words(pc.utf8_lower(large(column)), ALNUM, LOWER)


def feature_lists(column) -> list[bytes]:
    """For each text its features as sorted 32-bit numbers, each once."""
    out = []
    for w in text_words(column):
        row, index = (np.concatenate(x) for x in zip(*features(w)))
        pairs = np.unique((row << BITS) | index)
        cut = np.searchsorted(pairs, np.arange(w.last - w.first + 1) << BITS)
        low = (pairs & ((1 << BITS) - 1)).astype(np.uint32)
        out += [low[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
    return out


def fit(lists: list[np.ndarray], labels: np.ndarray, alpha=ALPHA, beta=BETA, l1=L1, l2=L2, epochs=EPOCHS) -> Weights:
    """Trains on documents in the order given. Features of a single document are left out."""
    none = np.zeros(0, np.int64)
    if len(set(labels.tolist())) < 2:
        return Weights(none, none.astype(np.float32), -50.0)
    seen = np.zeros(1 << BITS, np.uint32)
    for x in lists:
        seen[x] += 1
    known = np.flatnonzero(seen > 1)
    number = np.zeros(1 << BITS, np.int32)
    number[known] = np.arange(len(known), dtype=np.int32)
    lists = [number[x[seen[x] > 1]] for x in lists]
    del seen, number
    z, n = np.zeros(len(known)), np.zeros(len(known))
    bias_z = bias_n = 0.0
    for _ in range(epochs):
        for x, y in zip(lists, labels.tolist()):
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) <= l1, 0.0, (np.sign(zx) * l1 - zx) / ((beta + root) / alpha + l2))
            bias = -bias_z / ((beta + bias_n**0.5) / alpha)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -50, 50))) - y
            z[x] = zx + g - (np.sqrt(nx + g * g) - root) / alpha * w
            n[x] = nx + g * g
            bias_z += g - ((bias_n + g * g) ** 0.5 - bias_n**0.5) / alpha * bias
            bias_n += g * g
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    at = np.flatnonzero(w)
    return Weights(known[at], w[at].astype(np.float32), float(-bias_z / ((beta + bias_n**0.5) / alpha)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Weights:
    made, truth = labelled_sample(docs, labels, label, most, lambda b: pa.array(feature_lists(b.column("text")), pa.binary()), most_bytes)
    return fit([np.frombuffer(x, np.uint32) for x in made], truth)


def scores(column, model: Weights, dense: np.ndarray) -> np.ndarray:
    out = []
    for w in text_words(column):
        found = []
        for row, index in features(w):
            hit = np.flatnonzero(dense[index])
            found.append((row[hit] << BITS) | index[hit])
        pairs = np.unique(np.concatenate(found))
        total = np.bincount(pairs >> BITS, dense[pairs & ((1 << BITS) - 1)], minlength=w.last - w.first)
        out.append(1 / (1 + np.exp(-np.clip(total + model.bias, -50, 50))))
    return np.concatenate(out) if out else np.zeros(0)


def with_score(docs: DataFrame, model: Weights) -> tuple[DataFrame, str]:
    """docs with a column of scores, and its name."""
    held: list[np.ndarray] = []

    def made(batch: pa.RecordBatch) -> pa.Array:
        if not held:
            held.append(model.dense())
        return pa.array(scores(batch.column("text"), model, held[0]), pa.float64())

    return append(docs, "toxicity", T.DoubleType(), made)


def score_documents(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, for each row of docs."""
    out, name = with_score(docs.select("doc_id", "text"), train(docs, labels, most=most))
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col(name).alias("score"), (F.col(name) >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs that are not toxic, with all their columns."""
    out, name = with_score(docs, train(docs, labels, most=most))
    return out.filter(F.col(name) < THRESHOLD).drop(name)
