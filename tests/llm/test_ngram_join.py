import random

import numpy as np
import pytest

from tests.llm.helpers import ODD, documents, lower, words
from weftgraph.llm import ngram_join as J


def sets(text, k=5):
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(rows, t=0.8):
    s = [sets(r[1]) for r in rows]
    n, up = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and both >= t * (len(s[i]) + len(s[j]) - both):
                n[i] += 1
                n[j] += 1
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    best = {g: min(ids, key=lambda x: (x is None, x or 0)) for g, ids in groups.items()}
    return sorted(((rows[i][0], best[root(i)], n[i]) for i in range(len(rows))), key=str)


def corpus(seed=7):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(3000)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    shared, rows = text(60), []
    for g in range(25):
        base = text(r.randrange(20, 200))
        for c in range(r.randrange(1, 6)):
            t = list(base)
            for _ in range(r.randrange(0, 4)):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            rows.append(" ".join(t))
    rows += [" ".join(text(r.randrange(30, 90)) + shared) for _ in range(25)]
    base = text(150)
    for i in range(60):  # a large group of near copies, all different
        t = list(base)
        t[i] = f"x{i}"
        rows.append(" ".join(t))
    rows += [rows[0]] * 20
    r.shuffle(rows)
    return list(enumerate(rows)) + [(i + 1000 if i else i, *x) for i, *x in ODD]


@pytest.mark.parametrize("block_rows, block_shingles", [(2000, 2_000_000), (16, 2500)])
def test_against_brute_force(spark, block_rows, block_shingles):
    rows = corpus()
    got = J.near_duplicates(documents(spark, rows).repartition(3), block_rows=block_rows, block_shingles=block_shingles).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == brute(rows)
    kept = {}
    for r in got:
        kept[r.class_id, r.key if r.class_id is None else None] = kept.get((r.class_id, r.key if r.class_id is None else None), 0) + r.kept
    assert set(kept.values()) == {1}


def test_keep_one_keeps_columns(spark):
    rows = corpus(8)
    docs = documents(spark, rows)
    got = J.keep_one(docs)
    assert got.columns == docs.columns
    found = sorted(str(r.doc_id) for r in got.collect())
    assert found == sorted(str(x) for x in {(c if c is not None else i) for i, c, _ in brute(rows)})


def test_empty_table(spark):
    assert J.near_duplicates(documents(spark, [])).collect() == []
    assert J.keep_one(documents(spark, [])).collect() == []


def test_pruning_keeps_pairs_over_the_threshold():
    needed = J.least_matches()
    r = np.random.default_rng(3)
    one = r.integers(0, 1 << 16, J.HASHES).astype(np.uint16)
    for share, kept in ((0.82, 0.99), (0.9, 1.0)):
        many = np.where(r.random((2000, J.HASHES)) < share, one, r.integers(0, 1 << 16, (2000, J.HASHES)).astype(np.uint16))
        assert len(J.survivors(one, many, needed)) >= kept * 2000
    many = np.where(r.random((2000, J.HASHES)) < 0.3, one, r.integers(0, 1 << 16, (2000, J.HASHES)).astype(np.uint16))
    assert len(J.survivors(one, many, needed)) == 0


def test_signatures_estimate_similarity():
    r = np.random.default_rng(5)
    a = np.unique(r.integers(0, 2**63, 4000).astype(np.uint64))
    b = np.unique(np.concatenate([a[:3000], r.integers(0, 2**63, 1000).astype(np.uint64)]))
    s = J.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    assert abs((s[0] == s[1]).mean() - 3000 / 5000) < 0.12


@pytest.mark.parametrize("block_shingles, inner_rows", [(2_000_000, 256), (2500, 256), (400, 3)])
def test_keep_one_by_brute_force(spark, monkeypatch, block_shingles, inner_rows):
    """The smallest id of each group stays, however small the blocks in which groups are joined."""
    monkeypatch.setattr(J, "INNER_ROWS", inner_rows)
    rows = [(i, t) for i, t, *_ in corpus(11)]
    got = J.keep_one(documents(spark, rows).repartition(3), block_shingles=block_shingles)
    best = {}
    for i, group, _ in brute(rows):
        best.setdefault(group if group is not None else "none", i)
    want = sorted({str(g) for _, g, _ in brute(rows)})
    assert sorted(str(r.doc_id) for r in got.collect() if r.doc_id is not None) == [x for x in want if x != "None"]


def test_a_group_of_near_copies_ships_each_text_about_once(spark, monkeypatch):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(150)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i, k in enumerate(r.randrange(150) for _ in range(300))]
    rows += [(1000 + i, " ".join(base[:75] + [word() for _ in range(75)])) for i in range(20)]  # not alike, if likely
    shipped, real = [], J._joined
    monkeypatch.setattr(J, "_joined", lambda placed, *a: (shipped.append(placed.count()), real(placed, *a))[1])
    kept = sorted(r.doc_id for r in J.keep_one(documents(spark, rows), block_shingles=3000).collect())
    assert kept == [0, *range(1000, 1020)] and sum(shipped) < 2 * len(rows)


def test_large_parts_that_one_text_links(spark):
    """Two families that only a text between them links, in other blocks than the families' first texts."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(200)]
    end = list(base)
    end[190:] = [word() for _ in range(10)]
    far = list(end)
    far[:26] = [word() for _ in range(26)]
    families = [" ".join([*t, f"a{i}"]) for t in (base, far) for i in range(40)]
    rows = list(enumerate([*families, " ".join(end)]))
    classes = {c for _, c, _ in brute(rows)}
    for block in (2_000_000, 1500):
        assert len(J.keep_one(documents(spark, rows), block_shingles=block).collect()) == len(classes)
