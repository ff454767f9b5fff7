"""N-gram Jaccard join: near duplicates by runs of K words, with Bayesian pruning of candidates.

1. A pass over the texts makes each document's set of shingles (runs of K words), a 128-bit digest of the set and a MinHash
   signature. Documents with one digest have equal sets; they form a class and go on as one row.
2. Signatures are cut into bands. Classes that share a band's values are candidates. A bucket's classes are compared in
   blocks of bounded size: MinHash values are read a few at a time, and a pair is dropped as soon as the posterior
   probability that its similarity reaches the threshold falls below TOLERANCE. A bucket emits a spanning forest of the
   pairs that pass, never the pairs.
3. Components of these forests are groups of likely near duplicates. Each class's shingles are read again and brought to
   its group once; all pairs of a group are compared, pruned the same way at EXACT_TOLERANCE, and what is left is verified
   exactly by the sizes of the sets' intersections. A group beyond a block's size is spread over pairs of blocks.
4. What comes out is the number of links of each class and a spanning forest of the exact links, whose components are the
   near-duplicate groups.

Where only the groups are asked for (keep_one), step 3 compares no pair that hangs together already. A group is dealt to blocks once;
each block is joined exactly, what hangs together sends one representative on, and representatives are joined the same way, until they fit
one block. Only if a group of several blocks is still in parts, all but its largest part is compared with all of it. So a group of n
near copies ships each text once, and few of them again; a large group of many large parts costs its square in blocks.

A pair at the threshold shares no band with probability (1 - t^ROWS)^BANDS, 3e-6 at 0.8, and is pruned with a further 1e-5,
so 1.3e-5 in all (2e-6 at 0.82) would not bring two classes into one group by themselves; within a group hardly any link is lost.
For the numbers of links a group's pairs are all compared; that work, and the rows that pairs of blocks read, grow with
the square of a group beyond a block.

Words part at white space, A-Z in lower case. Similarity is the Jaccard index of the sets of shingles. Cases: a null text
is empty; a text of fewer than K words has one shingle of all its words; a text without words has none, is linked to
nothing and stands alone; a very long text is read whole, and is a block of its own where it passes a block's size; rows that repeat
(also with one doc_id) are rows of one class; a null doc_id is a row like others
and never names a group if another id can; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from weftgraph.operators.components import components
from weftgraph.stage import stage
from weftgraph.llm.batches import bounded
from weftgraph.llm.words import BY_SPACE, LOWER, join_hashes, mix, shingles, words

K = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
TOLERANCE, EXACT_TOLERANCE = 1e-6, 1e-12
STEP = 16
#: The most classes of a bucket, and shingles and classes of a group, in a block; smaller blocks where each text is shipped once.
BLOCK_ROWS, BLOCK_SHINGLES, GROUP_ROWS = 2000, 2_000_000, 10_000
INNER_SHINGLES, INNER_ROWS = 250_000, 256
#: The most bits of a filter that is sent to tasks.
FILTER_BITS = 1 << 26
_SIGNS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def shingle_sets(column, k: int = K) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, sorted distinct shingles of its rows, and row pointers, slice by slice."""
    for w in words(column, BY_SPACE, LOWER):
        runs, cut = shingles(w.hashes(), w.ptr, k, short=True)
        row = np.repeat(np.arange(w.last - w.first), np.diff(cut))
        order = np.lexsort((runs, row)) if w.last - w.first > 1 else np.argsort(runs)
        runs, row = runs[order], row[order]
        new = np.ones(len(runs), bool)
        new[1:] = (runs[1:] != runs[:-1]) | (row[1:] != row[:-1])
        yield w.first, runs[new], np.searchsorted(row[new], np.arange(w.last - w.first + 1))


def signatures(sets: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """HASHES MinHash values (32 bits) of each set that isn't empty. Bands use all bits, comparisons the low 16."""
    full = np.flatnonzero(np.diff(ptr))
    out = np.empty((len(full), HASHES), np.uint32)
    if len(full):
        begin = ptr[:-1][full]
        for j, sign in enumerate(_SIGNS):
            out[:, j] = np.minimum.reduceat(((sets ^ (sign >> np.uint64(7))) * sign) >> np.uint64(32), begin)
    return out


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, step: int = STEP) -> list[tuple[int, int]]:
    """(values read, matches needed to go on): below, the posterior of similarity >= threshold is under the tolerance.

    The prior is uniform, so after m matches in n values the posterior is Beta(m + 1, n - m + 1).
    """
    out = []
    for n in range(step, HASHES + 1, step):
        x = (np.arange(20_000) + 0.5) / 20_000
        for m in range(n + 1):
            log = m * np.log(x) + (n - m) * np.log1p(-x)
            p = np.exp(log - log.max())
            if p[x >= threshold].sum() / p.sum() >= tolerance:
                out.append((n, m))
                break
    return out


def survivors(one: np.ndarray, many: np.ndarray, needed: list[tuple[int, int]]) -> np.ndarray:
    """The rows of many whose signatures keep up with one's to the end."""
    left, matches, at = np.arange(len(many)), np.zeros(len(many), np.int64), 0
    for n, least in needed:
        matches = matches + (many[left, at:n] == one[at:n]).sum(1)
        keep = matches >= least
        left, matches, at = left[keep], matches[keep], n
        if not len(left):
            break
    return left


def _rows(columns: list, names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def _key(text):
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def row_filter(rows: DataFrame, most_bits: int = FILTER_BITS):
    """A Column function of (doc_id, key): false only for rows that are not among rows.

    It looks hashes up in a bitmap of 16 bits for each row and at most most_bits, which is what is sent to tasks; with more
    rows it lets more others through, and the exact join behind it does the rest. Tasks make their bitmaps, and parts of
    these are joined across tasks.
    """
    spark = rows.sparkSession
    bits = 1 << max(10, min(int(math.log2(most_bits)), math.ceil(math.log2(16 * max(1, rows.count())))))
    part = min(bits, 1 << 16)
    place = lambda id_, key: F.pmod(F.xxhash64(id_, key), F.lit(bits))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(bits, bool)
        for batch in batches:
            found[batch.column(0).to_numpy()] = True
        parts = found.reshape(-1, part)
        at = np.flatnonzero(parts.any(1))
        yield _rows([at, [np.packbits(parts[i]).tobytes() for i in at]], ["part", "bits"], [pa.int64(), pa.binary()])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(x, np.uint8)
                found[i] = found[i] | x if i in found else x
        yield _rows([list(found), [x.tobytes() for x in found.values()]], ["part", "bits"], [pa.int64(), pa.binary()])

    marked = rows.select(place(F.col("doc_id"), F.col("key")).alias("place")).mapInArrow(mark, "part bigint, bits binary")
    whole = np.zeros((bits // part, part // 8), np.uint8)
    for r in marked.repartition("part").mapInArrow(join, "part bigint, bits binary").toLocalIterator():
        whole[r.part] = np.frombuffer(r.bits, np.uint8)
    sent = spark.sparkContext.broadcast(whole.ravel())

    @F.pandas_udf(BooleanType())
    def among(place: pd.Series) -> pd.Series:
        p = place.to_numpy()
        return pd.Series((sent.value[p >> 3] >> (7 - (p & 7))) & 1).astype(bool)

    return lambda id_, key: among(place(id_, key))


def sketch(docs: DataFrame) -> DataFrame:
    """row, doc_id, key, digest, shingles, signature (binary) and bands for each row; without words the last three are null.

    row numbers the rows of this scan; key, the text's hash, and doc_id find a row in another scan.
    """
    schema = "row bigint, doc_id bigint, key binary, digest binary, shingles bigint, signature binary, bands array<bigint>"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets, ptr in shingle_sets(batch.column("text")):
                n = np.diff(ptr)
                full = np.flatnonzero(n)
                signs = signatures(sets, ptr)
                rows = batch.slice(first, len(n))
                digest, signature, bands = [None] * len(n), [None] * len(n), [None] * len(n)
                if len(full):
                    low, high = (np.add.reduceat(mix(sets ^ np.uint64(s)), ptr[:-1][full]) for s in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179))
                    keys = [join_hashes(np.full(len(full), b, np.uint64), *(signs[:, b * ROWS + r].astype(np.uint64) for r in range(ROWS))) for b in range(BANDS)]
                    keys = np.stack(keys, axis=1).view(np.int64)
                    for i, r in enumerate(full.tolist()):
                        digest[r], signature[r], bands[r] = low[i].tobytes() + high[i].tobytes(), signs[i].astype(np.uint16).tobytes(), keys[i]
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
                yield _rows([rows.column("row"), rows.column("doc_id"), rows.column("key"), digest, n, signature, bands], names, kinds)

    return bounded(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", _key(F.col("text")).alias("key"), "text").mapInArrow(run, schema)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows with equal keys (integers without nulls), from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for k, c in zip(keys, columns):
            new[1:] |= c[1:] != c[:-1]
            new[0] |= bool(held) and held[-1].column(k)[-1].as_py() != c[0]
        cut = np.flatnonzero(new).tolist()
        begin = 0
        for end in cut:
            if end > begin:
                held.append(batch.slice(begin, end - begin))
            yield pa.Table.from_batches(held)
            held, begin = [], end
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Disjoint sets over numbers 0 to n - 1, rooted at the smallest."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return int(i)

    def join(self, i: int, many: np.ndarray) -> None:
        roots = {self.root(int(j)) for j in many} | {self.root(i)}
        self.up[list(roots)] = min(roots)

    def edges(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        roots = np.array([self.root(i) for i in range(len(self.up))], np.int64)
        at = np.flatnonzero(roots != np.arange(len(roots)))
        return ids[roots[at]], ids[at]


def _block_pairs(df: DataFrame, blocks, row):
    """Rows once for each pair of blocks (i, j), i <= j, that their block is in: columns i, j, mine. One block: once."""
    mine = F.pmod(F.xxhash64(row, F.lit(3)), blocks)
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("other")
    return df.withColumn("mine", mine).select("*", other).select(*df.columns, "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))


def likely_links(classes: DataFrame, tolerance: float = TOLERANCE, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges (a, b) between classes: forests, by bucket, of the pairs that Bayesian pruning leaves."""
    needed = least_matches(threshold, tolerance)
    banded = stage(classes.select("class", F.explode("bands").alias("bucket")), "jaccard-bands")
    # buckets of the same classes are compared once
    marks = [F.bit_xor(F.xxhash64("class", F.lit(k))).alias(f"mark{k}") for k in (1, 2)]
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *marks).filter("n > 1")
    shared = stage(shared.groupBy("n", "mark1", "mark2").agg(F.min("bucket").alias("bucket")).select("bucket", "n"), "jaccard-buckets")
    members = stage(banded.join(shared, "bucket"), "jaccard-members")
    members = members.join(classes.select("class", "signature"), "class")
    placed = _block_pairs(members, F.ceil(F.col("n") / block_rows).cast("bigint"), F.col("class")).select("bucket", "i", "j", "mine", "class", "signature")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in sorted_groups(batches, ["bucket", "i", "j"]):
            signs = np.frombuffer(b"".join(group["signature"].to_pylist()), np.uint16).reshape(-1, HASHES)
            ids, mine = group["class"].to_numpy(), group["mine"].to_numpy()
            forest = Forest(len(ids))
            for x in range(len(ids) - 1):
                rest = np.arange(x + 1, len(ids))
                rest = rest[forest.up[rest] != forest.root(x)]  # those that hang on this one's tree need no comparison
                if mine[0] != mine[-1] or len(rest) and mine.min() != mine.max():
                    rest = rest[mine[rest] != mine[x]]
                near = rest[survivors(signs[x], signs[rest], needed)] if len(rest) else rest
                if len(near):
                    forest.join(x, near)
                    forest.up = forest.up[forest.up]
            from_, to = forest.edges(ids)
            a.append(from_)
            b.append(to)
            if len(a) >= 2000:
                yield _rows([np.concatenate(a), np.concatenate(b)], ["a", "b"], [pa.int64()] * 2)
                a, b = [], []
        if a:
            yield _rows([np.concatenate(a), np.concatenate(b)], ["a", "b"], [pa.int64()] * 2)

    return placed.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "class").mapInArrow(compare, "a bigint, b bigint")


class _Members:
    """The signatures and sets of shingles of a group's rows, and which of them are alike."""

    def __init__(self, group: pa.Table, needed: list[tuple[int, int]], threshold: float) -> None:
        self.ids, self.needed, self.threshold = group["class"].to_numpy(), needed, threshold
        self.signs = np.frombuffer(b"".join(group["signature"].to_pylist()), np.uint16).reshape(-1, HASHES)
        parts, counts = [], []
        for _, sets, ptr in shingle_sets(group["text"]):
            parts.append(sets)
            counts.append(np.diff(ptr))
        self.n = np.concatenate(counts)
        self.begin = np.cumsum(self.n) - self.n
        known, self.number = np.unique(np.concatenate(parts), return_inverse=True)
        self.mark = np.zeros(len(known), bool)

    def near(self, x: int, rest: np.ndarray) -> np.ndarray:
        """The rows of rest that are alike row x: by size, by signature, then exactly."""
        n, mark, number = self.n, self.mark, self.number
        rest = rest[np.minimum(n[rest], n[x]) >= self.threshold * np.maximum(n[rest], n[x])]
        rest = rest[survivors(self.signs[x], self.signs[rest], self.needed)] if len(rest) else rest
        if not len(rest):
            return rest
        own = number[self.begin[x] : self.begin[x] + n[x]]
        mark[own] = True
        size = n[rest]
        cut = np.cumsum(size) - size
        both = np.add.reduceat(mark[number[np.repeat(self.begin[rest] - cut, size) + np.arange(size.sum())]].astype(np.int64), cut)
        mark[own] = False
        return rest[both >= self.threshold * (size + n[x] - both)]


def _inside(docs: DataFrame, classes: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes of likely groups (class, root, size, shingles, signature), and one text for each (class, text)."""
    inside = stage(classes.join(groups, F.col("class") == F.col("id")).select("class", "doc_id", "key", "root", "size", "shingles", "signature"), "jaccard-inside")
    ids = inside.select("class", F.col("doc_id").alias("id"), F.col("key").alias("text_key"))
    among = row_filter(inside.select("doc_id", "key"))
    texts = docs.select("doc_id", _key(F.col("text")).alias("key"), "text").filter(among(F.col("doc_id"), F.col("key")))
    texts = texts.join(ids, (F.col("key") == F.col("text_key")) & F.col("doc_id").eqNullSafe(F.col("id")))
    return inside, stage(texts.groupBy("class").agg(F.first("text").alias("text")), "jaccard-texts")  # rows that repeat come once


def _blocks(members: DataFrame, block_shingles: int, block_rows: int = GROUP_ROWS) -> DataFrame:
    """root, blocks: how many blocks the members of a group fill."""
    most = F.greatest(F.ceil(F.sum("shingles") / block_shingles), F.ceil(F.count(F.lit(1)) / block_rows))
    return stage(members.groupBy("root").agg(most.cast("bigint").alias("blocks")), "jaccard-blocks")


def exact_links(docs: DataFrame, classes: DataFrame, groups: DataFrame, threshold: float = THRESHOLD, tolerance: float = EXACT_TOLERANCE, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """a, b, links: edges of forests of exact links (links null), and for a class the linked rows of one block pair (b null)."""
    needed = least_matches(threshold, tolerance)
    inside, texts = _inside(docs, classes, groups)
    placed = _block_pairs(inside.join(_blocks(inside, block_shingles), "root").select("class", "root", "size", "signature", "blocks"), F.col("blocks"), F.col("class"))
    placed = placed.select("root", "i", "j", "mine", "class", "size", "signature").join(texts, "class")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["root", "i", "j"]):
            mine, weight = (group[c].to_numpy() for c in ("mine", "size"))
            cross = mine.min() != mine.max()
            if not cross and group["i"][0] != group["j"][0]:
                continue
            members = _Members(group, needed, threshold)
            ids = members.ids
            forest, links = Forest(len(ids)), np.zeros(len(ids), np.int64)
            for x in range(len(ids) - 1):
                rest = np.arange(x + 1, len(ids))
                near = members.near(x, rest[mine[rest] != mine[x]] if cross else rest)
                if len(near):
                    links[x] += weight[near].sum()
                    links[near] += weight[x]
                    forest.join(x, near)
            a, b = forest.edges(ids)
            at = np.flatnonzero(links)
            none = lambda k: pa.nulls(k, pa.int64())
            columns = [pa.array(np.concatenate([a, ids[at]])), pa.concat_arrays([pa.array(b), none(len(at))]), pa.concat_arrays([none(len(a)), pa.array(links[at])])]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "links"])

    return placed.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "class").mapInArrow(verify, "a bigint, b bigint, links bigint")


def _joined(placed: DataFrame, keys: list[str], needed: list[tuple[int, int]], threshold: float) -> DataFrame:
    """a, b: a spanning forest, by group of keys, of the exact links between rows (class, signature, text, part, mine).

    Rows of one part hang together already. Where keys tell two blocks (i, j), only rows of different ones are compared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, keys):
            mine = group["mine"].to_numpy()
            cross = mine.min() != mine.max()
            if "j" in keys and not cross and group["i"][0] != group["j"][0]:
                continue
            members = _Members(group, needed, threshold)
            forest = Forest(len(mine))
            _, first, part = np.unique(group["part"].to_numpy(), return_index=True, return_inverse=True)
            forest.up = first[part]  # the parts, each under its first row
            for x in range(len(mine) - 1):
                rest = np.arange(x + 1, len(mine))
                if cross and "j" in keys:
                    rest = rest[mine[rest] != mine[x]]
                roots = forest.up
                while not np.array_equal(roots, roots[roots]):
                    roots = roots[roots]
                forest.up = roots
                near = members.near(x, rest[roots[rest] != roots[x]])
                if len(near):
                    forest.join(x, near)
            a, b = forest.edges(members.ids)
            yield _rows([a, b], ["a", "b"], [pa.int64()] * 2)

    return placed.repartition(*keys).sortWithinPartitions(*keys, "class").mapInArrow(run, "a bigint, b bigint")


def exact_groups(docs: DataFrame, classes: DataFrame, groups: DataFrame, threshold: float = THRESHOLD, tolerance: float = EXACT_TOLERANCE, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """a, b: edges whose components are those of all exact links between classes of the same likely group."""
    needed = least_matches(threshold, tolerance)
    inside, texts = _inside(docs, classes, groups)
    left, found, large, level = inside.select("root", "class", "shingles", "signature"), [], None, 0
    while True:
        level += 1
        blocks = _blocks(left, min(block_shingles, INNER_SHINGLES), INNER_ROWS)
        placed = left.join(blocks, "root").withColumns({"mine": F.pmod(F.xxhash64("class", F.lit(level)), F.col("blocks")), "part": F.col("class")})
        edges = stage(_joined(placed.select("root", "mine", "class", "signature", "part").join(texts, "class"), ["root", "mine"], needed, threshold), "jaccard-inner")
        found.append(edges)
        several = blocks.filter("blocks > 1").select("root")
        large = several if large is None else large
        before = left.join(several, "root", "left_semi")
        left = stage(before.join(edges.select(F.col("b").alias("class")), "class", "left_anti").select(left.columns), "jaccard-ahead")
        ahead = left.count()
        if not ahead or ahead > 0.7 * before.count():  # one block each, or hardly any that hang together
            break
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    if large.isEmpty():
        return every
    roots = components(every).select(F.col("id").alias("class"), F.col("root").alias("part"))
    members = inside.join(large, "root", "left_semi").join(roots, "class", "left").select("root", "class", "shingles", "signature", F.coalesce("part", "class").alias("part"))
    members = stage(members, "jaccard-parts")
    parts = members.groupBy("root", "part").agg(F.sum("shingles").alias("total"))
    open_ = parts.groupBy("root").agg(F.count(F.lit(1)).alias("parts"), F.max_by("part", F.struct("total", "part")).alias("most")).filter("parts > 1")
    open_ = stage(open_, "jaccard-open")
    if open_.isEmpty():
        return every
    members = members.join(open_, "root").withColumn("rest", F.col("part") != F.col("most"))
    counts = members.groupBy("root").agg(*(F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("rest") == r, F.col("shingles")).otherwise(0)) / block_shingles)).cast("bigint").alias(c) for r, c in ((True, "low"), (False, "high"))))
    members = members.join(stage(counts, "jaccard-sides"), "root")
    # blocks 0 to low - 1 have the smaller parts, the others the largest; each of the former meets itself, the later ones of them, and all others
    zero, hashed = F.lit(0).cast("bigint"), F.xxhash64("class", F.lit(5))
    mine = F.when(F.col("rest"), F.pmod(hashed, F.col("low"))).otherwise(F.col("low") + F.pmod(hashed, F.col("high")))
    meets = F.explode(F.when(F.col("rest"), F.sequence(zero, F.col("low") + F.col("high") - 1)).otherwise(F.sequence(zero, F.col("low") - 1))).alias("other")
    placed = members.withColumn("mine", mine).select("root", "class", "signature", "part", "mine", meets)
    placed = placed.select("root", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "class", "signature", "part", "mine").join(texts, "class")
    return every.unionByName(stage(_joined(placed, ["root", "i", "j"], needed, threshold), "jaccard-cross"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES, count_links: bool = True) -> DataFrame:
    """A row for each row of docs: doc_id, key, class_id, n_links (null unless count_links), class_size, kept.

    class_id: the smallest doc_id of its group of near duplicates (components of links). n_links: how many other rows have a
    similarity of at least the threshold. class_size: rows with an equal set of shingles. kept: for one row of each group,
    that with the smallest doc_id. key: the hash of its text.
    """
    rows = stage(sketch(docs), "jaccard-rows")
    own = F.when(F.col("digest").isNull(), F.col("row"))  # texts without words stand alone
    firsts = stage(rows.filter("digest is not null").groupBy("digest", "shingles").agg(F.min("row").alias("class"), F.count(F.lit(1)).alias("size")), "jaccard-firsts")
    sketches = rows.select(F.col("row").alias("class"), "doc_id", "key", "signature", "bands")
    classes = stage(firsts.join(sketches, "class"), "jaccard-classes")
    groups = components(likely_links(classes, tolerance, threshold, block_rows))
    strict = min(tolerance, EXACT_TOLERANCE)
    if count_links:
        found = stage(exact_links(docs, classes, groups, threshold, strict, block_shingles), "jaccard-links")
        exact = components(found.filter("b is not null").select("a", "b"))
        links = stage(found.filter("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links")), "jaccard-counts")
        known = firsts.join(exact, F.col("class") == F.col("id"), "left").join(links, "class", "left")
        n_links = F.coalesce("links", F.lit(0)) + F.col("size") - 1
    else:
        known = firsts.join(components(exact_groups(docs, classes, groups, threshold, strict, block_shingles)), F.col("class") == F.col("id"), "left")
        n_links = F.lit(None).cast("bigint")
    known = stage(known.select("digest", "shingles", F.coalesce("root", "class").alias("root"), n_links.alias("n_links"), "size"), "jaccard-known")
    placed = rows.select("row", "doc_id", "key", "digest", "shingles").join(known, ["digest", "shingles"], "left")
    placed = stage(placed.select("row", "doc_id", "key", F.coalesce("root", own).alias("root"), (F.coalesce("n_links", F.lit(0)) if count_links else n_links).alias("n_links"), F.coalesce("size", F.lit(1)).alias("class_size")), "jaccard-placed")
    named = placed.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    named = stage(named.select("root", "class_id", F.col("first.row").alias("first")), "jaccard-named")
    return placed.join(named, "root").select("doc_id", "key", "class_id", "n_links", "class_size", (F.col("row") == F.col("first")).alias("kept"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row of each group of near duplicates (the smallest doc_id), with all columns of docs. docs is read several times.

    Rows are told apart by doc_id and text; of rows that agree in both, one is kept.
    """
    judged = near_duplicates(docs, threshold, tolerance, block_shingles=block_shingles, count_links=False)
    judged = stage(judged.groupBy("doc_id", "key").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "jaccard-judged")
    names, key, id_, other = docs.columns, "text key", "text id", "other key"
    while {key, id_, other} & set(names):
        key, id_, other = key + "_", id_ + "_", other + "_"
    whole = docs.withColumn(key, _key(F.col("text")))

    def picked(rows: DataFrame, how: str) -> DataFrame:
        rows = rows.select(F.col("doc_id").alias(id_), F.col("key").alias(other))
        return whole.join(rows, (F.col(key) == F.col(other)) & F.col("doc_id").eqNullSafe(F.col(id_)), how)

    gone = judged.filter("not kept or n > 1")
    among = row_filter(gone)(F.col("doc_id"), F.col(key))
    clear = whole.filter(~among)
    whole = whole.filter(among)
    kept = clear.unionByName(picked(gone, "left_anti"))
    again = judged.filter("kept and n > 1")
    if not again.isEmpty():
        kept = kept.unionByName(picked(again, "left_semi").dropDuplicates(["doc_id", key]))
    return kept.select(*(F.col(f"`{c}`") for c in names))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = rf"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < {K} then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - {K} + 2), lambda i: array_to_string(w[i:i + {K} - 1], ' ')) end) as s from w),
e as (select doc_id, len(s) as n, hash(unnest(s)) as h from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as common, any_value(a.n) as na, any_value(b.n) as nb
  from e a join e b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p where common >= {THRESHOLD} * (na + nb - common)),
u as (select a, b from l union all select b, a from l),
c(id, root) as (select doc_id, doc_id from documents union select u.b, c.root from c join u on c.id = u.a where c.root < u.b),
m as (select id, min(root) as class_id from c group by id),
k as (select a as id, count(*) as n from u group by a)
select doc_id, class_id, coalesce(k.n, 0) as n_links, doc_id = class_id as kept
from documents join m on doc_id = m.id left join k on doc_id = k.id
"""
