"""Language identification: multinomial naive Bayes over hashed character n-grams.

Words are runs of letters (ASCII letters in lower case, and all that isn't ASCII), with a mark before and after; features are their
runs of one to MOST characters, hashed. Tasks count the features of all learning rows by language, a reduction tree sums the
counts, and the table of log probabilities is sent to the tasks, which score whole texts slice by slice: for each
language the logs of a slice's features are looked up and summed by row.

The table has 2^BITS features for each language, fewer bits where there are many languages: CELLS numbers (64 MB) at most. More than
MAX_LANGS different values are refused: such a column doesn't tell languages.

Cases: a null text, and one without a letter (Unicode's), is `und` with score 0; so is every text if nothing could be learned;
null languages teach nothing, the empty string is a language like others; of languages that tie the first by code point is
told; rows that repeat count each, rows with a null doc_id teach nothing and are scored; long texts are counted and scored
whole; other columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.batches import bounded
from weftgraph.llm.labelled import fold
from weftgraph.llm.shares import totals
from weftgraph.llm.words import LOWER, join_hashes, large, text_slices, words

MOST = 4
BITS, CELLS, MAX_LANGS = 16, 1 << 24, 4096
SMOOTHING = 0.5
#: Folds of doc_id, and the one that teaches nothing.
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"
#: Bytes of letters; those of characters that aren't ASCII count as letters.
LETTERS = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])


def features(column, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of rows: the first row, the hashed features, row by row, and the rows' pointers in them."""
    for w in words(pc.utf8_lower(large(column)), LETTERS, LOWER):
        if not len(w):
            yield w.first, np.zeros(0, np.int64), np.zeros(w.last - w.first + 1, np.int64)
            continue
        begins = (w.data & 0xC0) != 0x80
        begins[w.starts] = True
        at = np.flatnonzero(begins)
        wide = np.append(w.data, np.zeros(3, np.uint8)).astype(np.uint64)
        size = np.diff(at, append=len(w.data))
        char = wide[at]
        for k in (1, 2, 3):
            char |= np.where(size > k, wide[np.minimum(at + k, len(w.data))], np.uint64(0)) << np.uint64(8 * k)
        first, last = np.searchsorted(at, w.starts), np.searchsorted(at, w.ends)
        n = last - first
        ptr = np.concatenate(([0], np.cumsum(n + 2)))  # a mark (0) before and after each word
        marked = np.zeros(ptr[-1], np.uint64)
        into = np.repeat(ptr[:-1] + 1 - (np.cumsum(n) - n), n) + np.arange(n.sum())
        marked[into] = char[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        word = np.repeat(np.arange(len(n)), n + 2)
        row = w.rows()
        found, owner = [], []
        for k in range(1, MOST + 1):
            if len(marked) < k:
                break
            ok = np.flatnonzero(marked if k == 1 else word[k - 1 :] == word[: len(word) - k + 1])
            h = join_hashes(*(marked[i : len(marked) - k + 1 + i] for i in range(k)))[ok] + np.uint64(k)
            found.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int32))
            owner.append(row[word[ok]])
        # rows are in order within each length: merge by counting
        counts = [np.bincount(o, minlength=w.last - w.first) for o in owner]
        total = np.concatenate(([0], np.cumsum(np.sum(counts, axis=0))))
        out, used = np.empty(total[-1], np.int32), total[:-1].copy()
        for f, o, c in zip(found, owner, counts):
            out[np.repeat(used - (np.cumsum(c) - c), c) + np.arange(len(f))] = f
            used += c
        yield w.first, out, total


@dataclass(frozen=True)
class Model:
    """The languages by code point; a row of log probabilities for each, and their logs of priors."""

    langs: list[str]
    table: np.ndarray
    prior: np.ndarray

    @property
    def bits(self) -> int:
        return int(self.table.shape[1]).bit_length() - 1


def model_of(counts: np.ndarray, langs: list[str], rows: list[int]) -> Model:
    """From the counts of features by language, and the languages' numbers of rows."""
    smooth = counts + SMOOTHING
    table = np.log(smooth / smooth.sum(1, keepdims=True)).astype(np.float32)
    return Model(langs, table, np.log(np.array(rows, np.float64) / sum(rows)) if langs else np.zeros(0))


def train(docs: DataFrame, learn: Column) -> Model:
    """From the rows of docs (text, lang) for which learn holds: all of them, whole."""
    rows = docs.filter(learn & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGS + 1).collect()
    if len(found) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    found.sort(key=lambda r: r.lang)
    langs = [r.lang for r in found]
    if not langs:
        return Model([], np.zeros((0, 1 << BITS), np.float32), np.zeros(0))
    bits = min(BITS, int(math.log2(CELLS // len(langs))))
    number = {x: i for i, x in enumerate(langs)}

    def count(batch: pa.RecordBatch, table: np.ndarray) -> None:
        lang = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
        table = table.reshape(len(langs), -1)
        for first, found, ptr in features(batch.column("text"), bits):
            own = lang[first : first + len(ptr) - 1]
            of = np.repeat(own, np.diff(ptr))
            for i in np.unique(own):
                table[i] += np.bincount(found if len(own) == 1 else found[of == i], minlength=1 << bits)

    counts = totals(rows, len(langs) << bits, count).reshape(len(langs), -1)
    return model_of(counts, langs, [r.n for r in found])


def posteriors(column, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest language of each text, by number, and its posterior probability."""
    best, share = [], []
    for _, found, ptr in features(column, model.bits):
        n = len(ptr) - 1
        logs = np.repeat(model.prior[:, None], n, axis=1)
        full = np.flatnonzero(np.diff(ptr))
        if len(full):
            for i, table in enumerate(model.table):
                logs[i, full] += np.add.reduceat(table[found], ptr[:-1][full], dtype=np.float64)
        top = logs.argmax(0)
        best.append(top)
        share.append(1 / np.exp(logs - logs[top, np.arange(n)]).sum(0))
    return np.concatenate([np.zeros(0, np.int64), *best]), np.concatenate([np.zeros(0), *share])


def guess(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs."""
    letter = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))
    if not model.langs:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = pa.array(model.langs, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch):
                best, share = posteriors(piece.column("text"), sent.value)
                letters = piece.column("letter")
                lang, score = pc.if_else(letters, names.take(pa.array(best)), UNKNOWN), pc.if_else(letters, pa.array(share), 0.0)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), lang, score], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.when(letter, F.col("text").cast("string")).otherwise(F.lit("")).alias("text"), letter.alias("letter"))
    return bounded(rows).mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs; rows of the fold HELD_OUT, and those without an id, teach nothing."""
    own = fold(F.col("doc_id"), FOLDS)
    model = train(docs, (own != HELD_OUT) & F.col("doc_id").isNotNull())
    out = guess(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
