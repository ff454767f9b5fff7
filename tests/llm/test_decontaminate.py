import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import LONG, ODD, documents
from weftgraph.llm import decontaminate as C


def item(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def hashed(texts):
    return [h for w in C.text_words(pa.array(texts, pa.large_string())) for h in np.split(w.hashes(), w.ptr[1:-1])]


def plain_tiling(a, b, k):
    """Words of b covered by greedy string tiling, by the textbook's loops."""
    marked_a, marked_b, covered = [False] * len(a), [False] * len(b), 0
    while True:
        best = (0, 0, 0)
        for j in range(len(b)):
            for i in range(len(a)):
                m = 0
                while i + m < len(a) and j + m < len(b) and a[i + m] == b[j + m] and not marked_a[i + m] and not marked_b[j + m]:
                    m += 1
                if m > best[0]:
                    best = (m, i, j)
        m, i, j = best
        if m < k:
            return covered
        for x in range(m):
            marked_a[i + x] = marked_b[j + x] = True
        covered += m


def setup():
    r = random.Random(4)
    items = [(i, item(r, 30 + i)) for i in range(8)] + [(8, "too short"), (9, None), (None, item(r, 30))]
    w = [(t or "").split() for _, t in items]
    noise = lambda n: item(r, n)
    rows = [
        (100, f"{noise(50)} {items[0][1].upper()}, {noise(30)}"),
        (101, " ".join([noise(10), *w[1][15:], noise(5), *w[1][:15], noise(10)])),  # two halves, swapped
        (102, " ".join([noise(10), *w[2][20:], noise(3), *w[2][10:20], noise(3), *w[2][:10]])),  # three parts
        (103, " ".join([noise(40), *w[3][:10], noise(20)])),  # a third
        (104, noise(200)),
        (105, " ".join([*w[4], *w[5][:20], noise(9)])),
        (106, " ".join(w[6][i // 4 * 4 + 3 - i % 4] if i // 4 * 4 + 3 < len(w[6]) else w[6][i] for i in range(len(w[6])))),  # shuffled below five words
        (107, "too short"),
        (108, f"{items[10][1]}"),
    ]
    return items, rows


def frames(spark, items, rows):
    return documents(spark, rows), spark.createDataFrame([(*x, "t") for x in items], "item_id bigint, text string, coverage string")


def test_against_plain_tiling(spark):
    items, rows = setup()
    got = {r.doc_id: r for r in C.find_leaks(*frames(spark, items, rows)).collect()}
    for i, text in rows:
        cover = {}
        for j, t in items:
            b = (t or "").lower().split()
            if b:
                cover[j] = plain_tiling(text.lower().replace(",", "").split(), b, min(C.K, len(b))) / len(b)
        leaks = {j: c for j, c in cover.items() if c >= C.THRESHOLD}
        r = got[i]
        assert (r.contaminated, r.items) == (bool(leaks), len(leaks))
        if leaks:
            assert abs(r.coverage - max(leaks.values())) < 1e-12 and leaks[r.item_id] == max(leaks.values())
    assert {i for i, r in got.items() if r.contaminated} == {100, 101, 102, 105, 107, 108}
    assert got[101].tiles == 2 and got[102].tiles == 3 and got[105].items == 2


def test_blocks_agree_with_one_pass(spark):
    items, rows = setup()
    docs, bench = frames(spark, items, rows)
    one, many = ({r.doc_id: (r.contaminated, r.coverage, r.items) for r in C.find_leaks(docs, bench, block_words=n).collect()} for n in (500_000, 60))
    assert one == many


def test_blocks_keep_repeated_and_null_ids_apart(spark):
    items, rows = setup()
    rows += [(100, "clean"), (104, items[0][1]), (None, "clean too"), (None, items[1][1]), (None, None)]
    docs, bench = frames(spark, items, rows)
    one, many = (sorted(map(str, C.find_leaks(docs, bench, block_words=n).collect())) for n in (500_000, 60))
    assert one == many and len(many) == len(rows)


def test_random_texts_against_plain_tiling():
    r = random.Random(9)
    for _ in range(60):
        a, b = ([r.choice("xyz") for _ in range(r.randrange(5, 40))] for _ in range(2))
        seeds = C.seeds_of([1], hashed([" ".join(b)]), 3)
        (got,) = C.judge(pa.array([" ".join(a)]), seeds, [x.bitmap() for x in seeds], 0.0)
        assert round((got["coverage"] if got else 0) * len(b), 6) == plain_tiling(a, b, 3)


def test_drop_keeps_columns_and_empty_tables(spark):
    items, rows = setup()
    docs, bench = frames(spark, items, rows + ODD)
    kept = C.drop_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i in [103, 104, 106, *(x[0] for x in ODD)])
    none, no_bench = frames(spark, [], [])
    assert C.find_leaks(none, bench).collect() == []
    assert C.find_leaks(docs, no_bench).filter("contaminated").collect() == []


def test_odd_texts_in_blocks(spark):
    """Rows and verdicts are the same with one block and with many, on nulls, empty and long texts and repeated ids."""
    items, rows = setup()
    items = items + [(20, "Same text here"), (21, "one"), (22, LONG), (22, items[0][1])]
    docs, bench = frames(spark, items, rows + ODD + [(7, LONG[: len(LONG) * 2 // 3])])
    one, many = (sorted(map(str, C.find_leaks(docs, bench, block_words=n, item_words=1000).collect())) for n in (10**9, 60_000))
    assert one == many and len(many) == len(rows) + len(ODD) + 1
    assert sum("contaminated=True" in x and "item_id=20" in x for x in many) == 4 and sum("item_id=22" in x for x in many) == 2
    whole = sorted(map(str, C.find_leaks(docs, bench).collect()))
    assert whole == many
    kept = [sorted(str(r.doc_id) for r in C.drop_leaks(docs, bench, block_words=n, item_words=1000).collect()) for n in (10**9, 60_000)]
    assert kept[0] == kept[1] == sorted(x.split("doc_id=")[1].split(",")[0] for x in many if "contaminated=False" in x)


def test_one_repeated_word_stays_small():
    """8000 times one word against an item of 1000: the pairs are never held, and the tiling is the plain one's."""
    seeds = C.seeds_of([1], hashed(["word " * 1000]))
    tracemalloc.start()
    (got,) = C.judge(pa.array(["word " * 8000]), seeds, [x.bitmap() for x in seeds], 0.5)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == {"item_id": 1, "coverage": 1.0, "tiles": 1, "items": 1} and held < 200 << 20


def test_lines_that_many_items_share_stay_small():
    junk = " ".join(f"w{i}" for i in range(40))
    seeds = C.seeds_of(list(range(2000)), hashed([f"{junk} " + " ".join(f"x{i}y{j}" for j in range(60)) for i in range(2000)]))
    tracemalloc.start()
    got = C.judge(pa.array([f"{junk} " * 50] * 200), seeds, [x.bitmap() for x in seeds], 0.5)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [None] * 200 and held < 400 << 20


def test_pieces_of_pairs_change_nothing(monkeypatch):
    r = random.Random(3)
    texts, items = ([" ".join(r.choice("xyz") for _ in range(r.randrange(0, 60))) for _ in range(n)] for n in (20, 12))
    seeds = C.seeds_of(list(range(12)), hashed(items), 3)
    maps = [x.bitmap() for x in seeds]
    want = C.judge(pa.array(texts), seeds, maps, 0.4)
    monkeypatch.setattr(C, "PAIRS", 7)
    assert C.judge(pa.array(texts), seeds, maps, 0.4) == want and any(want)


@pytest.mark.parametrize("item_words", [20, 100, 333, 100_000])
def test_verdicts_do_not_depend_on_the_size_of_parts(spark, item_words):
    """A sixteenth of a long item is clean and two thirds of it are a leak, wherever they are cut, moved or repeated."""
    r = random.Random(12)
    w = item(r, 1000).split()
    noise = lambda n: item(r, n).split()
    texts = [w[470:530], noise(50) + w[:60], noise(600) + w[200:260] * 12, w[600:] + noise(7) + w[:260], w[100:590] + noise(500), w[100:601], noise(2000), w * 2, ["same"] * 900, w[:250] + noise(3) + w[300:551]]
    items = [(7, " ".join(w)), (8, "same " * 700), (9, item(r, 40))]
    docs, bench = frames(spark, items, [(i, " ".join(t)) for i, t in enumerate(texts)])
    for block_words in (150, 10**9):
        got = {x.doc_id: x for x in C.find_leaks(docs, bench, block_words=block_words, item_words=item_words).collect()}
        assert {i for i, x in got.items() if x.contaminated} == {3, 5, 7, 8, 9}
        for i, x in got.items():
            if x.contaminated:
                assert round(x.coverage * len(items[x.item_id - 7][1].split())) == plain_cover(texts[i], items[x.item_id - 7][1].split())
        assert got[3].item_id == 7 and got[8].item_id == 8 and got[9].tiles == 2


def plain_cover(a, b):
    """Greedy tiling by the lengths of common runs, kept in a table for speed."""
    marked_a, marked_b, covered = np.zeros(len(a), bool), np.zeros(len(b), bool), 0
    same = np.array([[x == y for y in b] for x in a])
    while True:
        free = same & ~marked_a[:, None] & ~marked_b[None, :]
        run = np.zeros((len(a) + 1, len(b) + 1), np.int32)
        for i in range(len(a) - 1, -1, -1):
            run[i, :-1] = np.where(free[i], run[i + 1, 1:] + 1, 0)
        m = int(run.max())
        if m < C.K:
            return covered
        j, i = np.argwhere(run.T == m)[0]
        marked_a[i : i + m] = marked_b[j : j + m] = True
        covered += m


def test_repeated_items_make_bounded_blocks(spark):
    r = random.Random(2)
    one = item(r, 100)
    items = [(i, one) for i in range(400)] + [(1000 + i, item(r, 100)) for i in range(30)]
    docs, bench = frames(spark, items, [(1, one), (2, items[-1][1]), (3, item(r, 100))])
    blocks = C.Blocks.of(C.item_parts(bench), 1000)
    sizes = [sum(len(x["hashes"]) // 8 for x in blocks.rows(b)) for b in range(blocks.n)]
    assert sum(sizes) == 31 * 100 and max(sizes) <= 1100 and blocks.n == 4
    got = {x.doc_id: (x.item_id, x.items) for x in C.find_leaks(docs, bench, block_words=1000).collect()}
    assert got == {1: (0, 400), 2: (1029, 1), 3: (None, 0)}


def test_several_blocks_against_plain_tiling(spark):
    items, rows = setup()
    docs, bench = frames(spark, items, rows)
    got = {r.doc_id: r for r in C.find_leaks(docs, bench, block_words=60, item_words=15).collect()}
    for i, text in rows:
        cover = {j: plain_tiling(text.lower().replace(",", "").split(), t.lower().split(), min(C.K, len(t.split()))) / len(t.split()) for j, t in items if t}
        leaks = [c for c in cover.values() if c >= C.THRESHOLD]
        assert (got[i].contaminated, got[i].items) == (bool(leaks), len(leaks)) and abs(got[i].coverage - max(leaks, default=0)) < 1e-12
