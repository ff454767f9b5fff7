import random

import numpy as np
import pyarrow as pa

from tests.llm.helpers import ODD, documents
from weftgraph.llm import quality as Q
from weftgraph.llm.words import LETTERS_OR_SIGNS, words


def corpus(n=600, seed=2):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 6))) for _ in range(120)]
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(vocabulary) for _ in range(r.randrange(30, 90))]
        bad = i % 4 == 0
        if bad:
            w = [x + r.choice(["%%%", "&&&"]) for x in w] if i % 8 else [w[0]] * len(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(not bad), 0))
    return rows, labels


def frames(spark, rows, labels):
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_documents_are_told_apart(spark):
    rows, labels = corpus()
    got = Q.score_documents(*frames(spark, rows, labels)).collect()
    truth = {i: q for i, q, _ in labels}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    # calibrated: the mean score is near the share of good documents
    assert abs(np.mean([r.score for r in held]) - np.mean([truth[r.doc_id] for r in held])) < 0.08


def index_vector(h):
    out = np.zeros(Q.DIM)
    for at, sign in Q.index_vectors(np.array([h], np.uint64)):
        out[at[0]] += sign[0]
    return out


def hashes_of(text):
    return [h for w in words(pa.array([text]), LETTERS_OR_SIGNS) for h in w.hashes()]


def test_context_vectors_by_brute_force(spark, monkeypatch):
    rows, _ = corpus(40)
    rows += [r[:2] for r in ODD if r[0] != 7]
    want = {}
    for _, text in rows:
        h = hashes_of(text)
        for a, b in zip(h, h[1:]):
            for x, y in ((a, b), (b, a)):
                at = int(x >> np.uint64(64 - Q.BITS))
                want[at] = want.get(at, 0) + index_vector(y)
    for fan_in in (256, 2):  # a tree of one level, and of several
        monkeypatch.setattr(Q, "FAN_IN", fan_in)
        got = Q.context_vectors(documents(spark, rows).repartition(7))
        full = np.flatnonzero(np.abs(got).sum(1))
        assert set(full.tolist()) == {k for k, v in want.items() if np.any(v)}
        assert all(np.array_equal(got[k], want[k]) for k in full.tolist())


def test_index_vectors_differ_by_word_and_are_sparse():
    h = np.random.default_rng(1).integers(0, 2**63, 4000).astype(np.uint64)
    vectors = {tuple((int(a[i]), int(s[i])) for a, s in Q.index_vectors(h)) for i in range(4000)}
    assert len(vectors) > 2500 and all(set(s.tolist()) == {1, -1} and set(a.tolist()) == set(range(Q.DIM)) for a, s in Q.index_vectors(h))


def test_pooling_by_brute_force():
    r = np.random.default_rng(3)
    table = Q.word_table(r.normal(size=(1 << Q.BITS, Q.DIM)))
    texts = ["a b, c!", "", None, "x " * 500 + "?? yes", "é ü"]
    got = Q.pooled(pa.array(texts), table)
    for row, text in zip(got, texts):
        h = hashes_of(text)
        own = np.mean([table[int(x >> np.uint64(64 - Q.BITS))] for x in h], axis=0) if h else np.zeros(Q.DIM)
        index = np.mean([index_vector(x) for x in h], axis=0) if h else np.zeros(Q.DIM)
        assert np.allclose(row, [*own, *index, np.linalg.norm(own), np.linalg.norm(index), np.log1p(len(h))], atol=1e-6)


def test_gradients_are_numeric_ones():
    r = np.random.default_rng(4)
    x, y = r.normal(size=(9, 5)), (r.random(9) > 0.5).astype(float)
    p = [r.normal(size=(5, 4)), r.normal(size=4), r.normal(size=4), r.normal(size=1)]

    def loss(p):
        z = np.tanh(x @ p[0] + p[1]) @ p[2] + p[3]
        return np.mean(np.logaddexp(0, z) - y * z) + Q.DECAY / 2 * ((p[0] ** 2).sum() + (p[2] ** 2).sum())

    for k, g in enumerate(Q.gradients(p, x, y)):
        for i in np.ndindex(p[k].shape):
            moved = [[a.copy() for a in p] for _ in range(2)]
            moved[0][k][i] += 1e-5
            moved[1][k][i] -= 1e-5
            assert abs((loss(moved[0]) - loss(moved[1])) / 2e-5 - g[i]) < 1e-7


def test_temperature_calibrates():
    r = np.random.default_rng(5)
    z = r.normal(0, 2, 20_000)
    truth = (r.random(20_000) < 1 / (1 + np.exp(-z))).astype(float)
    assert abs(Q.temperature_of(3 * z, truth) - 3) < 0.25 and abs(Q.temperature_of(z, truth) - 1) < 0.1


def test_odd_rows_and_empty_tables(spark):
    rows, labels = corpus(120)
    docs, lab = frames(spark, rows + [(i + 1000 if i else i, *r) for i, *r in ODD], labels + [(None, 1, 1)])
    got = Q.score_documents(docs, lab).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1001, 1002, 1003)}) == 1
    none, no_labels = frames(spark, [], [])
    assert Q.score_documents(none, lab).collect() == []
    assert {r.score for r in Q.score_documents(docs, no_labels).collect()} == {1.0}
