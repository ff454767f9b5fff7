"""Ratios and name joins against the standard library's matcher and plain loops."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.operators import matching as M

WORDS = st.lists(st.text("abcA \u00e9\u0130\U0001f600", max_size=14), min_size=1, max_size=12)


@settings(deadline=None, max_examples=150)
@given(WORDS, WORDS)
def test_ratios_are_the_standard_librarys(a, b):
    x, y = M.Names(a), M.Names(b)
    i, j = (v.ravel() for v in np.meshgrid(np.arange(len(a)), np.arange(len(b)), indexing="ij"))
    want = [M.similarity(a[p], b[q]) for p, q in zip(i, j)]
    assert M.ratios(x, i, y, j).tolist() == want
    used = np.flatnonzero(x.counts.any(0) & y.counts.any(0))
    for p in range(len(a)):
        assert all(bound >= w - 1e-12 for bound, w in zip(M.bounds(x, p, y, used), (M.similarity(a[p], t) for t in b)))


def test_long_names_and_many_pairs(monkeypatch):
    monkeypatch.setattr(M, "PAIRS", 7)
    r = random.Random(1)
    a = ["".join(r.choice("abcd") for _ in range(r.randrange(0, 300))) for _ in range(20)] + ["Customer#%09d" % i for i in range(30)]
    x = M.Names(a)
    i, j = (v.ravel() for v in np.meshgrid(np.arange(len(a)), np.arange(len(a)), indexing="ij"))
    assert M.ratios(x, i, x, j).tolist() == [M.similarity(a[p], a[q]) for p, q in zip(i, j)]


def names(seed, n=90):
    r = random.Random(seed)
    stems = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 12))) for _ in range(12)]
    return sorted({s[: r.randrange(0, len(s) + 1)] + r.choice("xyzXY") * r.randrange(3) + s[r.randrange(0, len(s)) :] for s in stems * (n // 12)})


@pytest.mark.parametrize("best", [False, True])
def test_alike_loses_no_pair(spark, monkeypatch, best):
    monkeypatch.setattr(M, "TALL", 9)
    monkeypatch.setattr(M, "WIDE", 14)
    left, right = names(1), names(2)
    frame = lambda x, c: spark.createDataFrame([(t,) for t in x] + [(None,)], f"{c} string")
    got = {(r.name, r.id): r.score for r in M.alike(frame(left, "name"), frame(right, "id"), 0.7, best=best).collect()}
    ratio = lambda n, i: SequenceMatcher(None, i.lower(), n.lower()).ratio()
    want = {(n, i): ratio(n, i) for n in left for i in right if ratio(n, i) >= 0.7}
    if best:  # at least the best of all, and nothing that isn't alike
        top = {n: max(s for (m, _), s in want.items() if m == n) for n, _ in want}
        assert got.items() <= want.items() and {k for k, s in want.items() if s == top[k[0]]} <= set(got)
    else:
        assert got == want


@pytest.mark.parametrize("seed", [3, 4])
def test_leaders_by_a_plain_loop(spark, seed):
    every = names(seed)
    order = list(range(len(every)))
    random.Random(seed).shuffle(order)
    rows = [(n, p // 2) for n, p in zip(every, order)]  # with ties
    kept, want = [], {}
    for n, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        score, at = max(((M.similarity(k, n), -i) for i, k in enumerate(kept)), default=(0.0, 0))
        want[n] = kept[-at] if kept and score >= 0.7 else n
        if want[n] == n:
            kept.append(n)
    got = {r.name: r.id for r in M.leaders(spark.createDataFrame(rows, "name string, pos bigint"), 0.7).collect()}
    assert got == want and len(kept) < len(every)


def test_leaders_of_nothing(spark):
    assert M.leaders(spark.createDataFrame([], "name string, pos bigint"), 0.8).collect() == []
