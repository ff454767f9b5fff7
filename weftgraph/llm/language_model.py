"""Language-model scores by deleted interpolation of bigrams, unigrams and a uniform share.

Counts cover all training documents and every word pair; nothing is pruned. Documents are read in chunks, whose words are
numbered once. Each chunk asks for the counts of its words and pairs, each once: a sorted list of 64-bit keys with the
chunk's own training counts. A list is cut into at most FAN pieces by the next bits of its keys, and the pieces of about FAN
lists meet in a node, which adds them up. As long as there is more than one group of lists, the sums are lists of their own
and go on by further bits; then totals go back the same way, each piece in the order asked. So a chunk sends a bounded
number of rows whatever the input, a key travels once a level (one level up to FAN chunks, two up to FAN squared), a word
that all documents share costs each chunk one entry, and no task holds more than the pieces of a node or a chunk.

The mixture has weights for each bucket of the context's count (its binary logarithm). They are learned by expectation
maximisation on held-out counts: each training occurrence is predicted from counts from which it was deleted. For that
occurrences are counted by bucket and by half-octaves of both estimates, a table of bounded size.

Words part at white space, A-Z in lower case; each text ends in one end token, whose context is the last word, or the
start for a text without words. Cases: a null text is empty and has the end token only; a long text is scored whole, and its
chunk is as long as it is; a null doc_id is a training document; rows that repeat count each; without training documents
probabilities are uniform; other columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.stage import stage
from weftgraph.llm.batches import bounded
from weftgraph.llm.packed import pack, pack_sorted, unpack, unpack_sorted
from weftgraph.llm.words import BY_SPACE, LOWER, join_hashes, words

FOLDS, HELD_OUT = 7, 2
CHUNK_TOKENS = 1 << 20
#: Bits of keys that part a list's pieces at a level; FAN is two to their power.
FAN_BITS = 7
EM_ROUNDS = 50
#: Tokens in a pass of arithmetic.
PIECE = 1 << 18
BUCKETS, STEPS = 48, 96
END, START = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A47)

def bucket_of(count: np.ndarray) -> np.ndarray:
    """0 for 0, else 1 and the whole binary logarithm."""
    return np.minimum(np.where(count > 0, 1 + np.log2(np.maximum(count, 1)).astype(np.int64), 0), BUCKETS - 1)


def trains(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % FOLDS != HELD_OUT


_CHUNK = "chunk bigint, docs bigint, train_tokens bigint, train_docs bigint, tokens bigint, ids binary, gone binary, lengths binary, train binary, vocabulary binary, often binary, words binary"


def by_count(often: np.ndarray) -> np.ndarray:
    """Words in the order of their numbers: frequent first, then by hash."""
    return np.argsort(-often.astype(np.int64), kind="stable")


def chunks(docs: DataFrame, chunk_tokens: int) -> DataFrame:
    """Documents by chunk: ids, numbers of tokens, training flags, the sorted hashes of the chunk's words, and each token's number among them."""

    def row(k: int, ids: list, counts: list, hashes: list) -> pa.RecordBatch:
        n, h = np.concatenate(counts), np.concatenate(hashes)
        train = np.array([trains(i) for i in ids], bool)
        vocabulary, at, often = np.unique(h, return_inverse=True, return_counts=True)
        rank = np.empty(len(often), np.int32)
        rank[by_count(often)] = np.arange(len(often), dtype=np.int32)  # small numbers for frequent words pack better
        key = (TaskContext.get().partitionId() << 32) + k
        numbers = np.array([0 if i is None else i for i in ids], np.int64)
        gone = np.array([i is None for i in ids], bool)
        blobs = [pack(numbers), pack(gone), pack(n.astype(np.int32)), pack(train), pack_sorted(vocabulary), pack(often.astype(np.int32)), pack(rank[at])]
        numbers_out = [key, len(ids), int(n[train].sum()), int(train.sum()), len(h)]
        names = [c.split()[0] for c in _CHUNK.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in numbers_out] + [pa.array([x], pa.binary()) for x in blobs], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, held, ids, counts, hashes = 0, 0, [], [], []
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for w in words(batch.column("text"), BY_SPACE, LOWER):
                n = w.counts()
                ids += names[w.first : w.last]
                counts.append(n + 1)
                hashes.append(np.insert(w.hashes(), w.ptr[1:], END))
                held += len(hashes[-1])
                if held >= chunk_tokens:
                    yield row(k, ids, counts, hashes)
                    k, held, ids, counts, hashes = k + 1, 0, [], [], []
        if ids:
            yield row(k, ids, counts, hashes)

    return bounded(docs).select("doc_id", "text").mapInArrow(run, _CHUNK)


@dataclass
class Chunk:
    """Tokens of a chunk: word numbers at, training flags, whether a token is a document's first, sorted keys of pairs."""

    vocabulary: np.ndarray
    at: np.ndarray
    train: np.ndarray
    first: np.ndarray
    lengths: np.ndarray

    @staticmethod
    def of(r) -> Chunk:
        n = unpack(r["lengths"]).astype(np.int64)
        first = np.zeros(int(n.sum()), bool)
        first[np.cumsum(n) - n] = True
        at = by_count(unpack(r["often"]))[unpack(r["words"])]
        return Chunk(unpack_sorted(r["vocabulary"]), at, np.repeat(unpack(r["train"]), n), first, n)

    def pair_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys of pairs, the order of tokens by key, and where each key starts in it."""
        h = self.vocabulary[self.at]
        before = np.empty_like(h)
        before[1:] = h[:-1]
        before[self.first] = START
        keys = join_hashes(before, h)
        del before, h
        order = np.argsort(keys)
        keys = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        begin = np.flatnonzero(new)
        return keys[begin], order, begin


_PIECES = "kind int, grp bigint, prefix bigint, next bigint, keys binary, counts binary"
_REPLIES = "kind int, grp bigint, prefix bigint, next bigint, totals binary, distinct bigint"


def _cut(kind: int, grp: int, prefix: int, keys: np.ndarray, counts: np.ndarray, level: int, bits: int) -> list[tuple]:
    """The pieces of a sorted list whose keys agree in the bits of the levels before."""
    digit = (keys >> np.uint64(64 - bits * (level + 1))) & np.uint64((1 << bits) - 1)
    cut = np.searchsorted(digit, np.arange((1 << bits) + 1, dtype=np.uint64))
    return [(kind, grp, prefix, prefix << bits | d, pack_sorted(keys[a:b]), pack(counts[a:b])) for d, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows)) or [()] * 6, kinds)], [c.split()[0] for c in _PIECES.split(", ")])


def requests(parts: DataFrame, bits: int = FAN_BITS) -> DataFrame:
    """Pieces of what each chunk (grp) asks: kind 0 for words, 1 for pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                c = Chunk.of(r)
                keys, order, begin = c.pair_keys()
                seen = np.add.reduceat(c.train[order].astype(np.int64), begin)
                alone = np.bincount(c.at[c.train], minlength=len(c.vocabulary))
                for kind, k, n in ((0, c.vocabulary, alone), (1, keys, seen)):
                    yield _piece_batch(_cut(kind, r["chunk"], 0, k, n, 0, bits))

    return parts.select("chunk", "lengths", "train", "vocabulary", "often", "words").mapInArrow(run, _PIECES)


def _added(group: pd.DataFrame) -> tuple[pd.DataFrame, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The pieces in order and their keys, all keys once, their sums, and the place of each piece's keys among them."""
    group = group.sort_values(["grp", "prefix"], ignore_index=True)
    lists = [unpack_sorted(x) for x in group["keys"]]
    keys = np.concatenate(lists)
    counts = np.concatenate([unpack(x).astype(np.int64) for x in group["counts"]])
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    return group, lists, keys[new], np.add.reduceat(counts[order], np.flatnonzero(new)), back


def _replied(group: pd.DataFrame, lists: list[np.ndarray], totals: np.ndarray, back: np.ndarray, distinct: int) -> pd.DataFrame:
    cut = np.cumsum([len(x) for x in lists])[:-1]
    told = np.zeros(len(group), np.int64)
    told[0] = distinct
    return pd.DataFrame({"kind": group["kind"], "grp": group["grp"], "prefix": group["prefix"], "next": group["next"], "totals": [pack(x) for x in np.split(totals[back], cut)], "distinct": told})


def answers(pieces: DataFrame, groups: int, bits: int = FAN_BITS, level: int = 0) -> DataFrame:
    """For each piece the totals of its keys over all groups, in the order asked.

    groups: how many lists there are for a prefix. distinct: keys that training has, told once for each.
    """
    after = max(1, math.ceil(groups / 2**bits))
    pieces = pieces.withColumn("to", F.pmod(F.xxhash64("grp", F.lit(level)), F.lit(after)))
    if after == 1:

        def reply(group: pd.DataFrame) -> pd.DataFrame:
            group, lists, _, totals, back = _added(group)
            return _replied(group, lists, totals, back, int(np.count_nonzero(totals)))

        return pieces.groupBy("kind", "next").applyInPandas(reply, _REPLIES)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        kind, to, nxt = (int(group[c].iloc[0]) for c in ("kind", "to", "next"))
        _, _, keys, totals, _ = _added(group)
        return pd.DataFrame([(kind, to, nxt, pack_sorted(keys), pack(totals))], columns=["kind", "grp", "prefix", "keys", "counts"])

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield _piece_batch(_cut(r["kind"], r["grp"], r["prefix"], unpack_sorted(r["keys"]), unpack(r["counts"]), level + 1, bits))

    def give_back(mine: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        group, lists, _, _, back = _added(mine)
        totals = np.concatenate([unpack(x).astype(np.int64) for x in above.sort_values("next")["totals"]])
        return _replied(group, lists, totals, back, int(above["distinct"].sum()))

    pieces = stage(pieces, "lm-pieces")
    sums = stage(pieces.groupBy("kind", "to", "next").applyInPandas(merge, "kind int, grp bigint, prefix bigint, keys binary, counts binary"), "lm-sums")
    above = answers(sums.mapInArrow(go_on, _PIECES), after, bits, level + 1)
    return pieces.groupBy("kind", "to", "next").cogroup(above.groupBy("kind", "grp", "prefix")).applyInPandas(give_back, _REPLIES)


_JOINED = "chunk bigint, ids binary, gone binary, lengths binary, words binary, single binary, pair binary, distinct bigint, cells array<int>, cell_counts array<bigint>"


def _half_octaves(x: np.ndarray) -> np.ndarray:
    """1 + the number of half octaves that 2 to the -STEPS / 2 is below x; 0 for 0."""
    return np.where(x > 0, np.clip(STEPS - 1 + np.round(2 * np.log2(np.maximum(x, 1e-300))), 1, STEPS - 1), 0).astype(np.int64)


def joined(parts: DataFrame, replies: DataFrame) -> DataFrame:
    """Chunks with the totals of their words, each token's pair total, and training occurrences by cell, deleted from the counts."""
    names = ["chunk", "ids", "gone", "lengths", "train", "vocabulary", "often", "words"]
    zero = F.lit(0).cast("bigint")
    left = parts.select(*names, F.lit(-1).alias("kind"), zero.alias("next"), F.lit(None).cast("binary").alias("totals"), zero.alias("distinct"), "all_tokens")
    right = replies.select(F.col("grp").alias("chunk"), *(F.lit(None).cast("binary").alias(c) for c in names[1:]), "kind", "next", "totals", "distinct", zero.alias("all_tokens"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        r = group[group["kind"] == -1].iloc[0]
        c = Chunk.of(r)
        single, total = (np.concatenate([unpack(x).astype(np.int64) for x in group[group["kind"] == k].sort_values("next")["totals"]]) for k in (0, 1))
        _, order, begin = c.pair_keys()
        pair = np.empty(len(order), np.int64)
        pair[order] = np.repeat(total, np.diff(np.append(begin, len(order))))
        del order, begin, total
        word, context = contexts(c, single)
        n = np.zeros(BUCKETS * STEPS**2, np.int64)
        for a in range(0, len(word), PIECE):
            t = np.flatnonzero(c.train[a : a + PIECE]) + a
            p, w, v = pair[t] - 1, word[t] - 1, context[t] - 1
            cell = (bucket_of(v) * STEPS + _half_octaves(p / np.maximum(v, 1))) * STEPS + _half_octaves(w / max(int(r["all_tokens"]) - 1, 1))
            n += np.bincount(cell, minlength=len(n))
        cells = np.flatnonzero(n)
        one = {"chunk": r["chunk"], "ids": r["ids"], "gone": r["gone"], "lengths": r["lengths"], "words": r["words"], "single": pack(single[by_count(unpack(r["often"]))]), "pair": pack(pair), "distinct": group["distinct"][group["kind"] == 0].sum(), "cells": cells.astype(np.int32), "cell_counts": n[cells]}
        return pd.DataFrame({k: [x] for k, x in one.items()})

    return left.unionByName(right).groupBy("chunk").applyInPandas(run, _JOINED)


def contexts(c: Chunk, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token the training count of its word and of its context; the start counts as often as the end."""
    word = single[c.at]
    context = np.empty_like(word)
    context[1:] = word[:-1]
    ends = np.flatnonzero(c.vocabulary == END)
    context[c.first] = single[ends[0]] if len(ends) else 0
    return word, context


def learn_weights(cells: dict[int, int], distinct: int, rounds: int = EM_ROUNDS) -> np.ndarray:
    """For each bucket the weights of the uniform share, of unigrams and of bigrams, by expectation maximisation."""
    weights = np.tile(np.array([0.05, 0.95, 0.0]), (BUCKETS, 1))
    if not cells:
        weights[:] = (1.0, 0.0, 0.0)
        return weights
    key, n = np.array(list(cells)), np.array(list(cells.values()), np.float64)
    value = lambda x: np.where(x > 0, 2.0 ** ((x - STEPS + 1) / 2), 0.0)
    bucket, p = key // STEPS**2, np.stack([np.full(len(key), 1 / (distinct + 1)), value(key % STEPS), value(key // STEPS % STEPS)], axis=1)
    for b in np.unique(bucket):
        pb, nb = p[bucket == b], n[bucket == b]
        w = np.array([0.1, 0.4, 0.5]) if b else np.array([0.2, 0.8, 0.0])
        for _ in range(rounds):
            share = pb * w
            share /= share.sum(1, keepdims=True)
            w = np.maximum((share * nb[:, None]).sum(0) / nb.sum(), [1e-6, 1e-6, 0.0])
            w /= w.sum()
        weights[b] = w
    known = np.unique(bucket[bucket > 0])
    for b in range(1, BUCKETS):  # a bucket that no deleted count fell in takes the nearest one's
        if b not in known and len(known):
            weights[b] = weights[known[np.argmin(abs(known - b))]]
    return weights


def scores(parts: DataFrame, weights: np.ndarray, tokens: int, distinct: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, gone, n = unpack(r["ids"]).astype(np.int64), unpack(r["gone"]), unpack(r["lengths"]).astype(np.int64)
                first = np.zeros(int(n.sum()), bool)
                begin = np.cumsum(n) - n
                first[begin] = True
                single, at, pair = unpack(r["single"]).astype(np.int64), unpack(r["words"]), unpack(r["pair"])
                word = single[at]
                context = np.empty_like(word)
                context[1:] = word[:-1]
                context[first] = word[begin + n - 1]  # the end's count is the start's
                log, base = np.empty(len(word)), np.empty(len(word))
                for a in range(0, len(word), PIECE):
                    n1, v, n2 = word[a : a + PIECE], context[a : a + PIECE], pair[a : a + PIECE]
                    w = weights[bucket_of(v)]
                    log[a : a + PIECE] = np.log10(w[:, 0] / (distinct + 1) + w[:, 1] * n1 / max(tokens, 1) + w[:, 2] * n2 / np.maximum(v, 1))
                    base[a : a + PIECE] = np.log10((n1 + 1) / (tokens + distinct + 1))
                total = lambda x: pa.array(np.add.reduceat(x, begin))
                held = np.array([not trains(None if g else i) for i, g in zip(ids.tolist(), gone.tolist())], bool)
                known = np.add.reduceat((word > 0).astype(np.int64), begin)
                columns = [pa.array(ids, mask=gone), pa.array(held), pa.array(n), pa.array(known), pa.array(np.full(len(n), tokens)), total(base), total(log)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return parts.select("ids", "gone", "lengths", "words", "single", "pair").mapInArrow(run, schema)


@dataclass
class Model:
    tokens: int
    distinct: int
    weights: np.ndarray


def fit_and_score(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS, fan_bits: int = FAN_BITS) -> tuple[DataFrame, Model]:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs; and the model."""
    parts = stage(chunks(docs, chunk_tokens), "lm-chunks")
    tokens, n = parts.agg(F.coalesce(F.sum("train_tokens"), F.lit(0)), F.count(F.lit(1))).first()
    replies = stage(answers(requests(parts, fan_bits), n, fan_bits), "lm-replies")
    both = stage(joined(parts.withColumn("all_tokens", F.lit(tokens).cast("bigint")), replies), "lm-joined")
    distinct = both.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]
    cells = both.select(F.explode(F.arrays_zip("cells", "cell_counts")).alias("x")).groupBy("x.cells").agg(F.sum("x.cell_counts").alias("n"))
    weights = learn_weights({r[0]: r[1] for r in cells.collect()}, distinct)
    return scores(both, weights, tokens, distinct), Model(tokens, distinct, weights)


def score_documents(docs: DataFrame) -> DataFrame:
    return fit_and_score(docs)[0]
