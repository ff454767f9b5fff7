"""Benchmark decontamination by greedy string tiling.

Runs of K words of all benchmark items are seeds. Documents are joined with them by running hashes (Karp-Rabin) over
whole texts; seeds on one diagonal (document position less item position) chain into matches. For each document and item
whose seeds could cover enough of the item, tiling takes the longest match whose words are unmarked in both, marks it as a
tile, and goes on with what is left of the others, down to K words. Tiles may come in any order, so a passage whose parts
were moved is found too. A document is contaminated if tiles cover at least THRESHOLD of an item's words.

What is sent and held has a bound whatever the sizes. Items go on as the hashes of their words; items of equal words are one
item that counts as often as it is there. Running sums of their words cut the benchmark into blocks of BLOCK_WORDS words, and one
item more at most; a block is a pass over the documents, and its broadcast is given up before the next one is made. Which items a document
could hold is told by its distinct seeds, PAIRS at a time; positions are then expanded for one document and item, PAIRS at
a time, and chained at once, so a text of one repeated word costs its diagonals and not its pairs.

An item of more than ITEM_WORDS words is sent in parts of so many, each with the first words of the next, so that each of its seeds is
in one part. Only documents that have half as many words as the whole item are asked. Their matches with all parts are brought
together, chained over the seams and tiled as those of one item. So neither the number of blocks nor ITEM_WORDS changes a row or a verdict.

Words are runs of letters and digits in lower case. Cases: null and empty texts hold nothing; an item of fewer than K words
is one seed of all its words, and is held where these follow each other; items without words match nothing; items that repeat are judged
each, and the smallest item_id of the best covered is told, null last; rows that repeat, and rows with null ids, are judged each; a long
text is read whole; other columns are not read, whatever their names; an empty table of documents gives an empty result, an empty
benchmark no leak. Several blocks write the documents once, so drop_leaks then takes no columns that Parquet can't hold.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.batches import bounded
from weftgraph.llm.labelled import append
from weftgraph.ordered import within_keys
from weftgraph.llm.packed import pack, unpack
from weftgraph.llm.words import ALNUM, LOWER, join_hashes, large, shingles, words
from weftgraph.stage import stage

K = 5
THRESHOLD = 0.5
#: The words of a block of seeds, and of a part of an item, at most about.
BLOCK_WORDS, ITEM_WORDS = 500_000, 100_000
#: Pairs of positions that are held at once.
PAIRS = 1 << 20
_FILTER_BITS = 22

RESULT = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("coverage", T.DoubleType()), T.StructField("tiles", T.IntegerType()), T.StructField("items", T.IntegerType())])
_ARROW = pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.int32()), ("items", pa.int32())])


def text_words(column):
    return words(pc.utf8_lower(large(column)), ALNUM, LOWER)


@dataclass(frozen=True)
class Seeds:
    """Items of a block with seeds of k words: ids, how often they are there, and word hashes; seeds by hash with item and position."""

    k: int
    ids: list[int | None]
    times: list[int]
    ptr: np.ndarray
    hashes: np.ndarray
    seed: np.ndarray
    item: np.ndarray
    at: np.ndarray

    @staticmethod
    def of(ids: list[int | None], times: list[int], lists: list[np.ndarray], k: int) -> Seeds:
        ptr, h = np.cumsum([0, *map(len, lists)]), np.concatenate([np.zeros(0, np.uint64), *lists])
        seed, cut = shingles(h, ptr, k, short=False)
        item = np.repeat(np.arange(len(ids)), np.diff(cut))
        order = np.argsort(seed, kind="stable")
        return Seeds(k, ids, times, ptr, h, seed[order], item[order], (np.arange(len(seed)) - cut[item])[order])

    def bitmap(self) -> np.ndarray:
        out = np.zeros(1 << _FILTER_BITS, bool)
        out[self.seed >> np.uint64(64 - _FILTER_BITS)] = True
        return out


def seeds_of(ids: list[int | None], lists: list[np.ndarray], k: int = K, times: list[int] | None = None) -> list[Seeds]:
    """The seeds of a block, from word hashes: of k words, and for items of fewer words of as many as these have."""
    sizes, times = np.array([min(len(h), k) for h in lists], np.int64), times or [1] * len(ids)
    return [Seeds.of([ids[i] for i in at], [times[i] for i in at], [lists[i] for i in at], int(n)) for n in np.unique(sizes[sizes > 0]) for at in [np.flatnonzero(sizes == n)]]


def chains(text: np.ndarray, seed: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start in the text, start in the item and number of seeds of all maximal runs on a diagonal.

    text: the running hashes of a text. seed, at: an item's seeds, sorted, and their positions.
    """
    lo, hi = np.searchsorted(seed, text, "left"), np.searchsorted(seed, text, "right")
    hit = np.flatnonzero(hi > lo)
    n = (hi - lo)[hit]
    total, found, first = np.cumsum(n), [], 0
    while first < len(hit):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + PAIRS, "right")))
        m = n[first:last]
        a = np.repeat(hit[first:last], m)
        b = at[np.repeat(lo[hit[first:last]] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
        found.append(_joined(a, b, np.ones(len(a), np.int64)))
        first = last
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return found[0] if len(found) == 1 else _joined(*(np.concatenate(x) for x in zip(*found)))


def _joined(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs that follow each other on a diagonal, as one."""
    order = np.lexsort((a, a - b))
    a, b, n = a[order], b[order], n[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != (a + n)[:-1]) | (b[1:] != (b + n)[:-1])
    begin = np.flatnonzero(new)
    return a[begin], b[begin], np.add.reduceat(n, begin)


def tile(a: np.ndarray, b: np.ndarray, m: np.ndarray, k: int, n: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of matches (m words at a in a text and at b in an item of n words) into (start, item start, length).

    Longest first; of equal lengths the earliest in the item, then in the text.
    """
    heap = [(-x, q, p) for x, q, p in zip(m.tolist(), b.tolist(), a.tolist())]
    heapq.heapify(heap)
    low = int(a.min())
    text, item, left = np.zeros(int((a + m).max()) - low, bool), np.zeros(n, bool), n
    tiles = []
    while heap and left >= k:
        m, q, p = heapq.heappop(heap)
        taken = text[p - low : p - low - m] | item[q : q - m]
        if not taken.any():
            text[p - low : p - low - m] = item[q : q - m] = True
            left += m
            tiles.append((p, q, -m))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([True], taken, [True]))))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if e - s >= k:
                heapq.heappush(heap, (s - e, q + s, p + s))
    return tiles


def candidates(row: np.ndarray, runs: np.ndarray, seeds: Seeds, threshold: float) -> Iterator[tuple[int, int]]:
    """Rows and items whose distinct seeds (runs of rows, each once, sorted by row) could cover enough of the item."""
    lo, hi = np.searchsorted(seeds.seed, runs, "left"), np.searchsorted(seeds.seed, runs, "right")
    hit = np.flatnonzero(hi > lo)
    row, lo, n = row[hit], lo[hit], (hi - lo)[hit]
    ends = np.append(np.flatnonzero(np.diff(row)) + 1, len(row)) if len(row) else np.zeros(0, np.int64)
    total, first = np.concatenate(([0], np.cumsum(n))), 0
    lengths = np.diff(seeds.ptr)
    while first < len(row):
        fits = ends[(ends > first) & (total[ends] <= total[first] + PAIRS)]
        last = int(fits[-1]) if len(fits) else int(ends[ends > first][0])  # whole rows; a row has each seed of the block once
        m = n[first:last]
        entry = np.repeat(lo[first:last] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        r, item, at = np.repeat(row[first:last], m), seeds.item[entry], seeds.at[entry]
        order = np.lexsort((at, item, r))
        r, item, at = r[order], item[order], at[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (item[1:] != item[:-1])
        begin = np.flatnonzero(new)
        step = np.full(len(r), seeds.k)
        step[:-1] = np.where(new[1:], seeds.k, np.minimum(seeds.k, np.diff(at)))
        could = np.add.reduceat(step, begin)  # words of the item under any seed
        good = begin[could >= threshold * lengths[item[begin]]]
        yield from zip(r[good].tolist(), item[good].tolist())
        first = last


def _rank(x: dict) -> tuple:
    return (-x["coverage"], x["item_id"] is None, x["item_id"] or 0)


def judge(column, block: list[Seeds], bitmaps: list[np.ndarray], threshold: float) -> list[dict | None]:
    """For each text its best covered item, or None where no item is covered enough."""
    out: list[dict | None] = []
    for w in text_words(column):
        best: list[dict | None] = [None] * (w.last - w.first)
        h = w.hashes()
        for seeds, bitmap in zip(block, bitmaps):
            runs, cut = shingles(h, w.ptr, seeds.k, short=False)
            hit = np.flatnonzero(bitmap[runs >> np.uint64(64 - _FILTER_BITS)])
            row = np.searchsorted(cut, hit, "right") - 1
            order = np.lexsort((runs[hit], row))
            row, seen = row[order], runs[hit][order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (seen[1:] != seen[:-1])
            own: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for r, i in candidates(row[new], seen[new], seeds, threshold):
                n = int(seeds.ptr[i + 1] - seeds.ptr[i])
                there, here = seeds.hashes[seeds.ptr[i] : seeds.ptr[i + 1]], h[w.ptr[r] : w.ptr[r + 1]]
                if i not in own:
                    seed, _ = shingles(there, np.array([0, n]), seeds.k, short=False)
                    by = np.argsort(seed, kind="stable")
                    own = {} if len(own) > 1000 else own
                    own[i] = seed[by], by
                a, b, m = chains(runs[cut[r] : cut[r + 1]], *own[i])
                tiles = [t for t in tile(a, b, m + seeds.k - 1, seeds.k, n) if np.array_equal(here[t[0] : t[0] + t[2]], there[t[1] : t[1] + t[2]])]
                coverage = sum(t[2] for t in tiles) / n
                if tiles and coverage >= threshold:
                    was, made = best[r], {"item_id": seeds.ids[i], "coverage": coverage, "tiles": len(tiles), "items": seeds.times[i]}
                    best[r] = made if was is None else min(was, made, key=_rank) | {"items": was["items"] + made["items"]}
        out += best
    return out


def item_parts(benchmark: DataFrame, k: int = K, item_words: int = ITEM_WORDS) -> DataFrame:
    """item (a digest of its words), n (their number), first, hashes (of words first to first + item_words, and k - 1 more), item_id
    (the smallest), times of each part of each distinct item, written."""
    names = ["item_id", "item", "n", "first", "hashes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item_id").to_pylist()
            for w in text_words(batch.column("text")):
                h = w.hashes()
                for row, a, b in zip(range(w.first, w.last), w.ptr[:-1].tolist(), w.ptr[1:].tolist()):
                    own = h[a:b]
                    place = np.arange(b - a, dtype=np.uint64)
                    digest = b"".join(int(join_hashes(place + np.uint64(salt), own).sum(dtype=np.uint64)).to_bytes(8, "big") for salt in (0, 1 << 40))
                    for first in range(0, max(1, b - a - k + 1) if b > a else 0, item_words):
                        columns = ([ids[row]], pa.int64()), ([digest], pa.binary()), ([b - a], pa.int64()), ([first], pa.int64()), ([own[first : first + item_words + k - 1].tobytes()], pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], names)

    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = bounded(items).mapInArrow(run, "item_id bigint, item binary, n bigint, first bigint, hashes binary")
    return stage(parts.groupBy("item", "n", "first").agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("times"), F.min("hashes").alias("hashes")), "leak-items")


@dataclass(frozen=True)
class Blocks:
    """Parts of items with the number of their block, and how many blocks there are."""

    parts: DataFrame
    n: int

    @staticmethod
    def of(parts: DataFrame, block_words: int) -> Blocks:
        words_ = parts.withColumns({"one": F.lit(0), "words": (F.octet_length("hashes") / 8).cast("bigint")})
        if (parts.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0) <= 8 * block_words:
            return Blocks(parts.withColumn("block", F.lit(0).cast("bigint")), 0 if parts.isEmpty() else 1)
        summed = within_keys(words_, "one", ["item", "first"], "leak-blocks", ("words",), 1 << 62)
        numbered = summed.withColumn("block", F.floor((F.col("words") - 1) / block_words))
        return Blocks(numbered, numbered.agg(F.max("block")).first()[0] + 1)

    def rows(self, block: int) -> list:
        """A block's parts, in a fixed order."""
        return sorted(self.parts.filter(F.col("block") == block).collect(), key=lambda r: (bytes(r["item"]), r["first"]))


def _hashes(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint64)


def whole_blocks(blocks: Blocks, k: int = K) -> Iterator[list[Seeds]]:
    """The seeds of items that are one part, block by block."""
    for b in range(blocks.n):
        rows = blocks.rows(b)
        if rows:
            yield seeds_of([r["item_id"] for r in rows], [_hashes(r["hashes"]) for r in rows], k, [r["times"] for r in rows])


def part_matches(column, parts: list[tuple[int, int, int]], seeds: Seeds, bitmap: np.ndarray, threshold: float) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Matches of texts with parts of items: row, part, starts in the text and in the item, numbers of seeds.

    parts: the item's number, the item's words and the first word of each part. Texts of too few words have none.
    """
    for w in text_words(column):
        h = w.hashes()
        runs, cut = shingles(h, w.ptr, seeds.k, short=False)
        for r in np.flatnonzero(w.counts() >= threshold * min(n for _, n, _ in parts)):
            text = runs[cut[r] : cut[r + 1]]
            hit = np.isin(seeds.seed, np.unique(text[bitmap[text >> np.uint64(64 - _FILTER_BITS)]]))
            for p in np.unique(seeds.item[hit]).tolist():
                _, n, first = parts[p]
                if w.ptr[r + 1] - w.ptr[r] < threshold * n:
                    continue
                mine = seeds.item == p
                a, b, m = chains(text, seeds.seed[mine], seeds.at[mine])
                here, there = h[w.ptr[r] : w.ptr[r + 1]], seeds.hashes[seeds.ptr[p] : seeds.ptr[p + 1]]
                same = [np.array_equal(here[x : x + l], there[y : y + l]) for x, y, l in zip(a, b, m + seeds.k - 1)]
                yield w.first + int(r), p, a[same], b[same] + first, m[same]


def long_leaks(rows: DataFrame, row: str, blocks: Blocks, k: int, threshold: float) -> DataFrame | None:
    """row, leak of rows that hold long items: matches with parts, block by block, then tiles of each row and item."""
    found, schema = [], f"`{row}` bigint, item binary, item_id bigint, times bigint, n bigint, starts binary, places binary, sizes binary"
    for b in range(blocks.n):
        own = blocks.rows(b)
        if not own:  # an item before it was longer than a block
            continue
        seeds = Seeds.of([r["item_id"] for r in own], [r["times"] for r in own], [_hashes(r["hashes"]) for r in own], k)
        told = [(bytes(r["item"]), r["item_id"], r["times"], r["n"]) for r in own]
        sent = rows.sparkSession.sparkContext.broadcast((seeds, [(0, r["n"], r["first"]) for r in own], told))

        def matches(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            seeds, parts, told = sent.value
            bitmap = seeds.bitmap()
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for r, p, a, at, m in part_matches(batch.column("text"), parts, seeds, bitmap, threshold):
                    cells = [ids[r], *told[p], pack(a), pack(at), pack(m)]
                    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds)], [row, "item", "item_id", "times", "n", "starts", "places", "sizes"])

        least = math.ceil(threshold * min(r["n"] for r in own))
        wide = bounded(rows.select(row, "text")).filter(F.octet_length("text") >= least)  # a word has a byte at least
        found.append(stage(wide.mapInArrow(matches, schema), "leak-matches"))
        sent.destroy()
    if not found:
        return None

    def tiled(key: tuple, group: pa.Table) -> pa.Table:
        n = group["n"][0].as_py()
        a, b, m = _joined(*(np.concatenate([unpack(x).astype(np.int64) for x in group[c].to_pylist()]) for c in ("starts", "places", "sizes")))
        tiles = tile(a, b, m + k - 1, k, n) if len(a) else []
        coverage = sum(t[2] for t in tiles) / n
        leak = {"item_id": group["item_id"][0].as_py(), "coverage": coverage, "tiles": len(tiles), "items": group["times"][0].as_py()}
        return pa.table({row: pa.array([key[0].as_py()], pa.int64()), "leak": pa.array([leak if tiles and coverage >= threshold else None], _ARROW)})

    every = reduce(DataFrame.unionByName, found)
    out = every.groupBy(row, "item").applyInArrow(tiled, T.StructType([T.StructField(row, T.LongType()), T.StructField("leak", RESULT)]))
    return out.filter("leak is not null")


def with_verdict(docs: DataFrame, block: list[Seeds], threshold: float = THRESHOLD) -> tuple[DataFrame, str, Broadcast]:
    """docs with a column of the best covered item of a block (null where none), its name, and what was sent for it."""
    sent = docs.sparkSession.sparkContext.broadcast(block)
    held: list[list[np.ndarray]] = []

    def made(batch: pa.RecordBatch) -> pa.Array:
        if not held:
            held.append([x.bitmap() for x in sent.value])
        return pa.array(judge(batch.column("text"), sent.value, held[0], threshold), _ARROW)

    return *append(docs, "leak", RESULT, made), sent


def _judged(docs: DataFrame, benchmark: DataFrame, k: int, threshold: float, block_words: int, item_words: int) -> tuple[DataFrame, str, DataFrame | None]:
    """docs with a column of leaks, its name, and None; or a copy of docs whose rows are numbered in that column, and their leaks."""
    parts = item_parts(benchmark, k, item_words)
    is_long = F.col("n") - (k - 1) > item_words
    short, long = Blocks.of(parts.filter(~is_long), block_words), Blocks.of(parts.filter(is_long), block_words)
    if short.n <= 1 and not long.n:
        out, name, _ = with_verdict(docs, next(whole_blocks(short, k), []), threshold)
        return out, name, None
    row = "row"
    while row in docs.columns:
        row += "_"
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()), "leak-rows")
    found = []
    for block in whole_blocks(short, k):
        out, name, sent = with_verdict(rows.select(row, "text"), block, threshold)
        found.append(stage(out.filter(F.col(name).isNotNull()).select(row, F.col(name).alias("leak")), "leak-found"))
        sent.destroy()
    more = long_leaks(rows, row, long, k, threshold)
    every = reduce(DataFrame.unionByName, found + ([more] if more is not None else []))
    order = F.struct(F.col("leak.coverage"), F.col("leak.item_id").isNotNull(), -F.col("leak.item_id"))
    best = every.groupBy(row).agg(F.max_by("leak", order).alias("leak"), F.sum("leak.items").cast("int").alias("items"))
    return rows, row, best.select(row, F.col("leak").withField("items", F.col("items")).alias("leak"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, k: int = K, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS, item_words: int = ITEM_WORDS) -> DataFrame:
    """A row for each row of docs: doc_id, contaminated, item_id, coverage, tiles, items (how many are covered enough)."""
    judged, leak, found = _judged(docs.select("doc_id", "text"), benchmark, k, threshold, block_words, item_words)
    if found is not None:
        judged, leak = judged.join(found, leak, "left"), "leak"
    x = lambda c: F.col(f"{leak}.{c}")
    return judged.select("doc_id", F.col(leak).isNotNull().alias("contaminated"), x("item_id"), F.coalesce(x("coverage"), F.lit(0.0)).alias("coverage"), F.coalesce(x("tiles"), F.lit(0)).alias("tiles"), F.coalesce(x("items"), F.lit(0)).alias("items"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, k: int = K, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS, item_words: int = ITEM_WORDS) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns."""
    judged, leak, found = _judged(docs, benchmark, k, threshold, block_words, item_words)
    if found is None:
        return judged.filter(F.col(leak).isNull()).drop(leak)
    return judged.join(found.select(leak), leak, "left_anti").drop(leak)
