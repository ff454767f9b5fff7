import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import ODD, documents, lower, words
from weftgraph.llm import language_model as L


def rows():
    r = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(60)]
    return [(i, " ".join(vocabulary[int(x)] for x in np.minimum(r.geometric(0.08, r.integers(1, 60)), 59))) for i in range(150)] + [(i + 1000 if i else i, *x) for i, *x in ODD]


@pytest.mark.parametrize("chunk, fan", [(2_000_000, 7), (400, 7), (400, 1), (400, 2)])
def test_against_plain_counts(spark, chunk, fan):
    """With one level of adding up, and with several."""
    data = rows()
    df, m = L.fit_and_score(documents(spark, data).repartition(3), chunk, fan)
    got = df.collect()
    tokens = [(i, [*words(lower(t)), None]) for i, t, *_ in data]
    train = [t for i, t in tokens if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    single, pairs = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(["start", *t], t))
    n, v = sum(single.values()), len(single)
    assert (m.tokens, m.distinct) == (n, v) and np.allclose(m.weights.sum(1), 1)
    before = lambda a, first: len(train) if first else single[a]
    want = []
    for i, t in tokens:
        base = sum(math.log10((single[w] + 1) / (n + v + 1)) for w in t)
        score = 0.0
        for k, w in enumerate(t):
            c = before(t[k - 1], k == 0)
            w0, w1, w2 = m.weights[0 if c == 0 else 1 + int(math.log2(c))]
            score += math.log10(w0 / (v + 1) + w1 * single[w] / n + w2 * (pairs["start" if k == 0 else t[k - 1], w] / c if c else 0))
        want.append((str(i), i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(t), sum(single[w] > 0 for w in t), n, base, score))
    found = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    assert [x[:5] for x in found] == [x[:5] for x in sorted(want)]
    for a, b in zip(found, sorted(want)):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)
    held = [x for x in found if x[1]]
    assert sum(x[6] for x in held) > sum(x[5] for x in held)  # better than the base on held-out texts


def test_weights_are_those_of_the_deleted_counts(spark):
    """EM on the table of cells agrees with EM on each occurrence."""
    data = [(i, "a b a b a c " * (1 + i % 3)) for i in range(60)]
    _, m = L.fit_and_score(documents(spark, data))
    train = [[*words(t), None] for i, t in data if zlib.crc32(str(i).encode()) % 7 != 2]
    single, pairs = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(["start", *t], t))
    n, v = sum(single.values()), len(single)
    by = {}
    for t in train:
        for k, w in enumerate(t):
            c = (len(train) if k == 0 else single[t[k - 1]]) - 1
            by.setdefault(0 if c == 0 else 1 + int(math.log2(c)), []).append((1 / (v + 1), (single[w] - 1) / (n - 1), (pairs["start" if k == 0 else t[k - 1], w] - 1) / c))
    for b, p in by.items():
        p, w = np.array(p), np.array([0.1, 0.4, 0.5])
        for _ in range(L.EM_ROUNDS):
            s = p * w
            w = (s / s.sum(1, keepdims=True)).mean(0)
        assert np.allclose(w, m.weights[b], atol=0.05)


def test_packing_round_trip():
    for x in (np.zeros(0, np.int64), np.array([5, 0, 2**60], np.int64), np.array([True, False])):
        assert np.array_equal(L.unpack(L.pack(x)), x)
    assert np.array_equal(L.unpack(L.pack(np.array([-3, 200, 0]))), [-3, 200, 0])
    s = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64))
    assert np.array_equal(L.unpack_sorted(L.pack_sorted(s)), s)


def test_empty_table(spark):
    assert L.score_documents(documents(spark, [])).collect() == []


def test_without_training_documents_probabilities_are_uniform(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    got = L.score_documents(documents(spark, [(i, "a b") for i in held])).collect()
    assert len(got) == 3 and all(r.score == 0.0 and r.train_tokens == 0 and r.n_known == 0 for r in got)
