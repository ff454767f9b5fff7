"""Names that are alike: Ratcliff-Obershelp ratios of many pairs at once, and joins of names on them.

The ratio of two names is twice the characters of their matching blocks, over the characters of both: of all common blocks
the longest (the first in the one name, then in the other) is taken, then the same is done left and right of it. Here all pairs
of a batch take a step together, in numpy.

A ratio can't be more than that of the characters that both names have, in any order, and that can't be more than twice the shorter
name's length over both lengths. So names are dealt to blocks by length, blocks whose lengths can't reach the threshold never meet,
and within two blocks only pairs whose common characters reach it are matched. No pair is lost.

Where all pairs are asked for, blocks are ranges of names in order, so the ids of a block differ in few places. What a name and these
have in common depends only on which of the name's characters stand in these places, so it is looked up in a table that tells it once.
"""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.ordered import within_keys
from weftgraph.stage import sorted_side, stage

#: Characters up to which names are matched in numpy; longer ones, of which there are few, by the standard library.
LONG = 64
#: Names of a block, and ids of the block that it meets; pairs that are matched at once.
TALL, WIDE, PAIRS = 500, 4000, 1 << 16
#: Meetings of blocks that are sent to tasks.
MEETINGS = 200_000
#: Places of a table of matching characters, a byte each, and bytes of the tables that a worker keeps.
TABLE, KEPT = 1 << 16, 1 << 26
_CLASSES = 64


def similarity(a: str, b: str) -> float:
    """The share of matching blocks of two names in lower case; not symmetric."""
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


class Names:
    """Names in lower case as rows of characters, and how often each has a character of each of 64 classes."""

    def __init__(self, texts: list[str]) -> None:
        self.low = [t.lower() for t in texts]
        self.size = np.array([len(t) for t in self.low], np.int64)
        flat = np.frombuffer("".join(self.low).encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.repeat(np.arange(len(texts)), self.size)
        self.counts = np.bincount(row * _CLASSES + flat % _CLASSES, minlength=len(texts) * _CLASSES).reshape(-1, _CLASSES).astype(np.int16)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.codes = np.zeros((len(texts), min(LONG, int(self.size.max(initial=0)))), np.uint32)
        short = place < LONG
        self.codes[row[short], place[short]] = flat[short]


def matched(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Characters in matching blocks of each pair of rows of a and b."""
    total = _begun(a, a_size, b, b_size)
    pair = np.arange(len(a))
    alo, ahi, blo, bhi = total.copy(), a_size.astype(np.int64), total.copy(), b_size.astype(np.int64)
    ok = (ahi > alo) & (bhi > blo)
    pair, alo, ahi, blo, bhi = (x[ok] for x in (pair, alo, ahi, blo, bhi))
    while len(pair):
        wide, tall = int((bhi - blo).max()), int((ahi - alo).max())
        column = np.arange(wide)
        at = blo[:, None] + column
        inside = at < bhi[:, None]
        other = b[pair[:, None], np.minimum(at, b.shape[1] - 1)]
        run = np.zeros((len(pair), wide + 1), np.int8)
        best, end_a, end_b = (np.zeros(len(pair), np.int64) for _ in range(3))
        for i in range(tall):
            row = alo + i
            mine = a[pair, np.minimum(row, a.shape[1] - 1)]
            same = inside & (other == mine[:, None]) & (row < ahi)[:, None]
            run[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
            top = run[:, 1:].max(1)
            better = np.flatnonzero(top > best)
            if len(better):
                best[better] = top[better]
                end_a[better] = i + 1
                end_b[better] = run[better, 1:].argmax(1) + 1
        hit = np.flatnonzero(best)
        pair, alo, ahi, blo, bhi, best, end_a, end_b = (x[hit] for x in (pair, alo, ahi, blo, bhi, best, end_a, end_b))
        np.add.at(total, pair, best)
        ea, eb = alo + end_a, blo + end_b
        left = alo, ea - best, blo, eb - best
        right = ea, ahi, eb, bhi
        pair = np.concatenate([pair, pair])
        alo, ahi, blo, bhi = (np.concatenate(x) for x in zip(left, right))
        ok = (ahi > alo) & (bhi > blo)
        pair, alo, ahi, blo, bhi = (x[ok] for x in (pair, alo, ahi, blo, bhi))
    return total


def _begun(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Characters that both of a pair begin with, where these are surely the longest common block; else 0.

    A block that has a character which each of both has once lies on it, so within this beginning. One that lacks it ends before it or
    begins behind it; it is not longer if what the shorter name has behind it isn't.
    """
    wide, least = min(a.shape[1], b.shape[1]), np.minimum(a_size, b_size).astype(np.int64)
    begin = np.logical_and.accumulate((a[:, :wide] == b[:, :wide]) & (np.arange(wide) < least[:, None]), axis=1)
    long, last = begin.sum(1), np.full(len(a), -1)
    for at in range(int(long.max(initial=0))):
        c = a[:, at : at + 1]
        once = [((x == c) & (np.arange(x.shape[1]) < size[:, None])).sum(1) == 1 for x, size in ((a, a_size), (b, b_size))]
        last[begin[:, at] & once[0] & once[1]] = at
    return np.where((last >= 0) & (least - last - 1 <= long), long, 0)


def ratios(x: Names, i: np.ndarray, y: Names, j: np.ndarray) -> np.ndarray:
    """The ratio of row i of x and row j of y, for each pair. Pairs whose characters are equal in the same places count once."""
    out = np.ones(len(i))
    m, n = x.size[i], y.size[j]
    for k in np.flatnonzero((m > LONG) | (n > LONG)).tolist():
        out[k] = SequenceMatcher(None, x.low[i[k]], y.low[j[k]]).ratio()
    short = np.flatnonzero((m <= LONG) & (n <= LONG) & (m + n > 0))
    for at in range(0, len(short), PAIRS):
        k = short[at : at + PAIRS]
        both = np.concatenate([x.codes[i[k]], y.codes[j[k]]], axis=1) if len(k) else np.zeros((0, 1), np.uint32)
        shape, back = _shapes(both, m[k], n[k])
        wide = x.codes.shape[1]
        total = matched(both[shape, :wide], m[k][shape], both[shape, wide:], n[k][shape])
        out[k] = 2.0 * total[back] / (m[k] + n[k])
    return out


def _shapes(both: np.ndarray, m: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs whose characters can be renamed into each other, one (its row), and for each pair the number of its one.

    Characters are numbered by their first place in the pair; matching blocks depend on nothing else.
    """
    if not len(both):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(both, axis=1, kind="stable")
    ranked = np.take_along_axis(both, order, axis=1)
    new = np.ones(ranked.shape, bool)
    new[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
    start = np.maximum.accumulate(np.where(new, np.arange(ranked.shape[1]), 0), axis=1)
    first = np.take_along_axis(order, start, axis=1).astype(np.uint8)
    named = np.empty_like(first)
    np.put_along_axis(named, order, first, axis=1)
    key = np.ascontiguousarray(np.column_stack([named, m.astype(np.uint8), n.astype(np.uint8)]))
    _, shape, back = np.unique(key.view(np.dtype((np.void, key.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return shape, back


def bounds(x: Names, i: int, y: Names, used: np.ndarray) -> np.ndarray:
    """At most what the ratios of name i of x with all of y are, by the characters that both have."""
    own = x.counts[i, used]
    both = np.minimum(y.counts[:, used], own).sum(1, dtype=np.int64)
    total = y.size + x.size[i]
    return np.where(total > 0, 2.0 * both / np.maximum(total, 1), 1.0)


class _Alike:
    """Ids of one length that differ in few places, and what names have in common with them."""

    #: By what both have in common: matching characters for what stands in the places that differ; -1: not told yet.
    tables: dict[tuple, np.ndarray] = {}

    def __init__(self, ids: Names, rows: np.ndarray, letters: np.ndarray) -> None:
        self.ids, self.rows, self.size = ids, rows, int(ids.size[rows[0]])
        codes = np.searchsorted(letters, ids.codes[rows, : self.size])
        differ = (codes != codes[0]).any(0)
        self.places, self.fixed = np.flatnonzero(differ), codes[0, ~differ]
        self.letters = np.unique(codes[:, differ])
        half = (len(self.places) + 1) // 2
        self.parts = [np.unique(codes[:, at], axis=0, return_inverse=True) for at in (self.places[:half], self.places[half:]) if len(at)]

    def matched(self, names: Names, i: int, number: np.ndarray, form: bytes) -> np.ndarray | None:
        """Matching characters of name i and each id; number: of its letters from 1 by first place, else 0. None: too many places."""
        here = number[self.letters]
        base = int(np.count_nonzero(here)) + 1
        if base ** len(self.places) > TABLE:
            return None
        own = np.zeros(len(number), np.int32)
        own[self.letters[here > 0]] = 1 + np.argsort(np.argsort(here[here > 0]))
        code, weight = np.zeros(len(self.rows), np.int32), 1
        for unique, back in self.parts:
            weights = weight * base ** np.arange(unique.shape[1])
            code += (own[unique] @ weights).astype(np.int32)[back.ravel()]
            weight *= base ** unique.shape[1]
        key = (self.size, form, self.places.tobytes(), number[self.fixed].tobytes(), np.sort(here[here > 0]).tobytes())
        table = self.tables.get(key)
        if table is None:
            if sum(map(len, self.tables.values())) + weight > KEPT:
                self.tables.clear()
            table = self.tables[key] = np.full(weight, -1, np.int8)
        out = table[code]
        if out.min() < 0:
            new = np.flatnonzero(out < 0)
            codes, first = np.unique(code[new], return_index=True)
            j, n = self.rows[new[first]], len(codes)
            mine = np.broadcast_to(names.codes[i], (n, names.codes.shape[1]))
            table[codes] = matched(self.ids.codes[j], self.ids.size[j], mine, np.full(n, names.size[i]))
            out = table[code]
        return out


def _pairs(names: Names, ids: Names, rank: tuple[np.ndarray, np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (name, id) of at least the threshold, and their ratios; rank: only ids before the name."""
    used = np.flatnonzero(names.counts.any(0) & ids.counts.any(0))
    found, left, right, held = [], [], [], 0
    letters = np.unique(np.concatenate([names.codes.ravel(), ids.codes.ravel()]))
    by_size = (np.flatnonzero(ids.size == n) for n in np.unique(ids.size[(ids.size > 0) & (ids.size <= LONG)]))
    groups = [_Alike(ids, rows, letters) for rows in by_size]
    other = (ids.size == 0) | (ids.size > LONG)

    def flush() -> None:
        nonlocal held
        i, j = np.concatenate([*left, np.zeros(0, np.int64)]), np.concatenate([*right, np.zeros(0, np.int64)])
        score = ratios(ids, j, names, i)
        ok = score >= threshold
        found.append((i[ok], j[ok], score[ok]))
        left.clear()
        right.clear()
        held = 0

    for i in range(len(names.low)):
        m, before, open_ = int(names.size[i]), None if rank is None else rank[1] < rank[0][i], other.copy()
        if 0 < m <= LONG:
            one, first = np.unique(names.codes[i, :m], return_index=True)
            number = np.zeros(len(letters), np.uint8)
            number[np.searchsorted(letters, one)] = 1 + np.argsort(np.argsort(first))
            form = number[np.searchsorted(letters, names.codes[i, :m])].tobytes()
        for group in groups:
            score = 2.0 * np.arange(min(m, group.size) + 1) / (m + group.size)
            if score[-1] < threshold:
                continue
            total = group.matched(names, i, number, form) if 0 < m <= LONG else None
            if total is None:
                open_[group.rows] = True
                continue
            ok = total >= np.searchsorted(score, threshold)
            if before is not None:
                ok &= before[group.rows]
            at = np.flatnonzero(ok)
            found.append((np.full(len(at), i), group.rows[at], score[total[at]]))
        if not open_.any():
            continue
        likely = open_ & (bounds(names, i, ids, used) >= threshold)
        if before is not None:
            likely &= before
        j = np.flatnonzero(likely)
        left.append(np.full(len(j), i))
        right.append(j)
        held += len(j)
        if held >= 4 * PAIRS:
            flush()
    flush()
    return tuple(np.concatenate(x) for x in zip(*found))


def _best(names: Names, ids: Names, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each name the ids of its largest ratio of at least the threshold, and the ratio.

    In rounds, for all names at once: the ids of the largest bounds that were not matched yet, more of them each round, until no
    bound is left that reaches the name's best ratio.
    """
    used = np.flatnonzero(names.counts.any(0) & ids.counts.any(0))
    n, m = len(names.low), len(ids.low)
    left = np.array([bounds(names, i, ids, used) for i in range(n)]).reshape(n, m)
    least, active, step, found = np.full(n, threshold), np.arange(n), 16, []
    while len(active):
        own = np.where(left[active] >= least[active, None], left[active], -1.0)
        k = min(step, m)
        j = np.argpartition(-own, k - 1, axis=1)[:, :k]
        row, at = np.nonzero(np.take_along_axis(own, j, axis=1) >= 0)
        i, j = active[row], j[row, at]
        score = ratios(ids, j, names, i)
        np.maximum.at(least, i, score)
        found.append((i, j, score))
        left[i, j] = -1.0  # matched
        active, step = np.unique(i), step * 4
    i, j, score = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    ok = score >= least[i]
    return i[ok], j[ok], score[ok]


def _bins(counts: list[tuple[int, int]], most: int) -> list[tuple[int, int, int, int]]:
    """(shortest, longest, parts, first block) of bins of neighbouring lengths: about `most` names in each part of a bin."""
    out: list[tuple[int, int, int, int]] = []
    held, block = [], 0
    for size, n in [*sorted(counts), (None, most)]:
        if held and sum(x for _, x in held) + n > most:
            parts = max(1, math.ceil(sum(x for _, x in held) / most))
            out.append((held[0][0], held[-1][0], parts, block))
            held, block = [], block + parts
        held.append((size, n))
    return out


def _could(a: tuple, b: tuple, threshold: float) -> bool:
    """Whether names of two bins of lengths can reach the threshold: at best all characters of the shorter are matched."""
    short, long = min(a[1], b[1]), max(a[0], b[0])
    return short >= long or 2 * short >= threshold * (short + long)


def alike(names: DataFrame, ids: DataFrame, threshold: float, best: bool = False, ranked: bool = False) -> DataFrame:
    """name, id, score of pairs with a ratio of at least the threshold; null names and ids have none.

    best: for a name only its largest ratio within a block of ids, with ties. ranked: only ids before the name, by a column
    rank (text) of both. The driver holds the numbers of names by length, the first and last rank of blocks, and which of them meet.
    """
    spark = names.sparkSession
    own = ["rank"] if ranked else []
    names, ids = (df.select(c, *own).filter(F.col(c).isNotNull()) for df, c in ((names, "name"), (ids, "id")))
    sizes = [[(r[0], r[1]) for r in df.groupBy(F.length(F.lower(c)).alias("size")).count().collect()] for df, c in ((names, "name"), (ids, "id"))]
    left, right = (_bins(s, most) for s, most in zip(sizes, (TALL, WIDE)))
    meet = [(a[3] + i, b[3] + j) for a in left for b in right if _could(a, b, threshold) for i in range(a[2]) for j in range(b[2])]

    def placed(df: DataFrame, column: str, bins: list[tuple], most: int, block: str) -> DataFrame:
        told = spark.createDataFrame([(size, b[2], b[3]) for b in bins for size in range(b[0], b[1] + 1)], "size int, parts int, first int")
        rank = [F.col("rank").alias(f"rank_{block}")] if ranked else []
        rows = df.withColumn("low", F.lower(column)).withColumn("size", F.length("low")).join(F.broadcast(told), "size")
        if best or all(b[2] == 1 for b in bins):
            return rows.select(column, *rank, (F.col("first") + F.pmod(F.xxhash64(column), F.col("parts"))).cast("int").alias(block))
        own = within_keys(rows.select(column, *rank, "low", "first", "parts"), "first", ["low"], "names-in-order")
        at = F.least(F.col("parts") - 1, F.floor(F.col("place") / most))
        return own.select(column, *(F.col(f"rank_{block}") for _ in rank), (F.col("first") + at).cast("int").alias(block))

    rows = [placed(df, c, bins, most, block) for df, c, bins, most, block in ((names, "name", left, TALL, "r"), (ids, "id", right, WIDE, "c"))]
    if ranked and len(meet) > 1:
        last, first = (dict(df.groupBy(block).agg(end(f"rank_{block}")).collect()) for df, block, end in zip(rows, "rc", (F.max, F.min)))
        meet = [(r, c) for r, c in meet if r in last and c in first and first[c] < last[r]]

    def dealt(df: DataFrame, block: str) -> DataFrame:
        met = spark.createDataFrame([(k, x[block == "c"]) for k, x in enumerate(meet)], f"meeting bigint, {block} int")
        return df.join(F.broadcast(met) if len(meet) <= MEETINGS else met, block).drop(block)

    def compare(key: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        one, two = Names(x["name"].to_pylist()), Names(y["id"].to_pylist())
        rank = None
        if ranked:
            after, before = x["rank_r"].to_pylist(), y["rank_c"].to_pylist()
            if max(before, default="") >= min(after, default=""):
                _, place = np.unique(np.array(after + before, object), return_inverse=True)
                rank = place[: len(after)], place[len(after) :]
        i, j, score = _best(one, two, threshold) if best else _pairs(one, two, rank, threshold)
        return pa.table({"name": x["name"].combine_chunks().take(pa.array(i)), "id": y["id"].combine_chunks().take(pa.array(j)), "score": pa.array(score, pa.float64())})

    parts = max(1, min(len(meet), 4 * spark.sparkContext.defaultParallelism))
    a, b = (dealt(df, block).repartition(parts, "meeting") for df, block in zip(rows, "rc"))
    return a.groupBy("meeting").cogroup(b.groupBy("meeting")).applyInArrow(compare, "name string, id string, score double")


#: Rows of candidates that reach Python at once.
_CANDIDATES = 50_000


def _shortened(df: DataFrame, column: str) -> DataFrame:
    """column, key: each name in lower case without one of its characters."""
    low = F.lower(column)
    without = F.transform(F.sequence(F.lit(1), F.length(low)), lambda i: F.concat(F.substring(low, F.lit(1), i - 1), F.substring(low, i + 1, F.length(low))))
    return df.filter(F.length(low) > 0).select(column, F.explode(F.array_distinct(without)).alias("key"))


def one_off(names: DataFrame, ids: DataFrame, threshold: float) -> DataFrame:
    """name, id, score: for names from which some id differs by one character more or less, the ids of the largest ratio.

    Names of at least three characters that equal no id without regard to case. What is matched is a common subsequence, so the ratio
    is 1 - d / (m + n), where d characters of both aren't matched. An id with d = 1 has at least 1 - 1 / (2n - 1); one with d > 1 at
    most 1 - 2 / (2n + 2), which is less. So the ids that these keys join are all that can be best, if one of them has d = 1.
    """
    names, ids = (df.select(c).filter(F.col(c).isNotNull()).distinct() for df, c in ((names, "name"), (ids, "id")))
    names = names.filter(F.length(F.lower("name")) > 2)
    longer = _shortened(names, "name").join(sorted_side(ids.withColumn("key", F.lower("id"))), "key").select("name", "id")
    shorter = names.withColumn("key", F.lower("name")).join(sorted_side(_shortened(ids, "id")), "key").select("name", "id")

    def score(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _CANDIDATES):
                x = batch.slice(at, _CANDIDATES)
                left, right = Names(x["name"].to_pylist()), Names(x["id"].to_pylist())
                every = np.arange(x.num_rows)
                d = left.size + right.size
                got = ratios(right, every, left, every)
                ok = (np.rint((1.0 - got) * d) == 1) & (got >= threshold)
                yield pa.record_batch({"name": x["name"], "id": x["id"], "score": pa.array(got, pa.float64())}).filter(pa.array(ok))

    scored = stage(longer.unionByName(shorter).mapInArrow(score, "name string, id string, score double"), "names-one-off")
    best = scored.groupBy("name").agg(F.max("score").alias("score"))
    return scored.join(sorted_side(best), ["name", "score"]).select("name", "id", "score")


def leaders(names: DataFrame, threshold: float) -> DataFrame:
    """name, id of names (name, pos) that are read in order: each means the most similar one before it that means itself, else itself.

    Of two that are as similar the earlier one counts. Who means itself is settled in rounds over the pairs that are alike: a name does
    if none before it that is alike does; so no task holds a group of names that hang together.
    """
    ranked = names.select("name", F.concat(F.lpad(F.col("pos").cast("string"), 20, "0"), "name").alias("rank"))
    pairs = stage(alike(ranked, ranked.withColumnRenamed("name", "id"), threshold, ranked=True), "name-pairs")
    edges = stage(pairs.select("name", "id"), "name-edges")
    kept = stage(names.select("name").distinct().join(edges.select("name").distinct(), "name", "left_anti"), "names-kept")
    every = kept
    while not edges.isEmpty():
        taken = stage(edges.join(kept.select(F.col("name").alias("id")), "id", "left_semi").select("name").distinct(), "names-taken")
        left = edges.join(taken, "name", "left_anti")  # of the names that are still open, the pairs with open ones
        left = left.join(taken.select(F.col("name").alias("id")), "id", "left_anti")
        left = stage(left.select("name", "id"), "name-edges")
        open_ = edges.select("name").distinct().join(taken, "name", "left_anti")
        kept = stage(open_.join(left.select("name").distinct(), "name", "left_anti"), "names-kept")
        every, edges = every.unionByName(kept), left
    every = stage(every, "names-leaders")
    near = pairs.join(every.select(F.col("name").alias("id")), "id", "left_semi").join(every, "name", "left_anti")
    near = near.join(ranked.select(F.col("name").alias("id"), "rank"), "id")
    return every.select("name", F.col("name").alias("id")).unionByName(near.groupBy("name").agg(F.min_by("id", F.struct(-F.col("score"), "rank")).alias("id")))
