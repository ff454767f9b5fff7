import random
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.helpers import ODD, documents, words
from weftgraph.llm import mixing
from weftgraph.llm.mixing import mix_sources


def targets(rows, weights=(3, 1, 2), share=1.5, most=2.0):
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(words(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(size.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if most * size[s] <= level * weight[s]}
        if not full:
            out |= {s: level * weight[s] for s in open_}
            break
        out |= {s: most * size[s] for s in full}
        left -= sum(out[s] for s in full)
        open_ -= full
    return size, out


@pytest.mark.parametrize("leaf, fan_in", [(20_000, 500), (7, 3)])
def test_against_brute_force(spark, leaf, fan_in):
    r = random.Random(3)
    rows = [(i, " ".join("w" * r.randrange(1, 4) for _ in range(r.randrange(60))), r.choice(["a", "a", "a", "b", "é", "Z", None])) for i in range(600)] + [(600, "big " * 5000, "b"), (601, "x", "tiny"), (602, None, "none")]
    got = mix_sources(documents(spark, rows), leaf=leaf, fan_in=fan_in).collect()
    size, target = targets(rows)
    assert sorted(x.doc_id for x in got) == list(range(603))
    taken, largest = defaultdict(int), defaultdict(int)
    text = {i: t for i, t, _ in rows}
    for x in got:
        assert x.size == len(words(text[x.doc_id])) and x.source_size == size[x.source] and x.target == pytest.approx(target[x.source])
        assert x.taken == x.copies * x.size <= 2 * x.size
        taken[x.source] += x.taken
        largest[x.source] = max(largest[x.source], x.size)
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    for s in size:
        assert abs(taken[s] - target[s]) <= largest[s] + 1e-6
    again = {x.doc_id: x.copies for x in mix_sources(documents(spark, rows[::-1]), leaf=leaf, fan_in=fan_in).collect()}
    assert again == {x.doc_id: x.copies for x in got}


def test_odd_rows_and_empty_table(spark):
    rows = [(*r, "s")[:3] if len(r) == 2 else r for r in ODD]
    got = mix_sources(documents(spark, rows)).collect()
    assert len(got) == len(rows) and all(x.taken == 0 for x in got if x.size == 0)
    assert mix_sources(documents(spark, [])).collect() == []


def plain_pivots(items, draws, ends):
    """Pivotal rounding by its textbook form: two units meet until one is whole, weights are sizes. items: (size, fraction)."""
    out, open_ = {}, None
    for i, ((size, p), u) in enumerate(zip(items, draws)):
        if size == 0 or p in (0.0, 1.0):
            out[i] = int(p >= 1.0)
            continue
        if open_ is None:
            open_ = [i, size, p]
            continue
        j, s, q = open_
        words = q * s + p * size
        gain, loss = min((1 - q) * s, p * size), min(q * s, (1 - p) * size)
        q2 = q + gain / s if u * (gain + loss) < loss else q - loss / s
        p2 = (words - q2 * s) / size
        snap = lambda x: round(x) if abs(x - round(x)) < 1e-12 else x
        q2, p2 = snap(q2), snap(p2)
        if q2 in (0, 1):
            out[j] = int(q2)
            open_ = [i, size, p2]
        else:
            open_[2] = q2
        if p2 in (0, 1):
            out[i] = int(p2)
            open_ = None if open_[0] == i else open_
    if open_ is not None:
        out[open_[0]] = int(ends[open_[0]] < open_[2])
    return [out[i] for i in range(len(items))]


def rounded(items, marks, salt):
    rows = [{"source": "s", "node": 0, "doc_id": i, "size": s, "mark": m, "base": 0, "extra": None, "rest": p} for i, ((s, p), m) in enumerate(zip(items, marks))]
    got = [r for b in mixing._rounds(salt, True)(iter([mixing._made(rows[:17]), mixing._made(rows[17:])])) for r in b.to_pylist()]
    return [r["extra"] for r in sorted(got, key=lambda r: r["doc_id"])]


def test_rounding_is_the_plain_pivots_and_unbiased():
    r = random.Random(7)
    items = [(r.choice([0, 1, 3, 10, 40]), r.choice([0.0, 0.25, 0.5, 0.9])) for _ in range(40)]
    total = np.zeros(40)
    for salt in range(1500):
        marks = [r.getrandbits(62) for _ in items]
        got = rounded(items, marks, salt)
        assert got == plain_pivots(items, *mixing.draws(np.array(marks, np.int64), salt))
        assert abs(sum(x * s for x, (s, _) in zip(got, items)) - sum(p * s for s, p in items if s)) <= 40 + 1e-9
        total += got
    want = [p if s else 0.0 for s, p in items]
    assert np.abs(total / 1500 - want).max() < 5 * 0.5 / 1500**0.5  # expected copies are the fractions


def test_repeated_ids_and_sizes_across_leaves(spark):
    rows = [(None if i % 3 else 5, f"w{i} " * 4, "s") for i in range(900)] + [(7, "same text", "s")] * 90
    got = mix_sources(documents(spark, rows), leaf=50).collect()
    assert len(got) == 990 and abs(sum(x.taken for x in got) - 1.5 * sum(x.size for x in got)) <= 4
