import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tests.llm.helpers import ODD, documents
from weftgraph.llm import toxicity as X

INSULTS = ["grobnik", "snarfle", "vexmole"]


def corpus(n=700, seed=5):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(r.choice("abcdeo") for _ in range(r.randrange(2, 7))) for _ in range(r.randrange(20, 120))]
        toxic = i % 5 == 1
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(INSULTS))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def frames(spark, rows, labels):
    return documents(spark, rows), spark.createDataFrame([(*x, "t") for x in labels], "doc_id bigint, quality int, toxic int, text string")


def test_held_out_documents_are_told_apart(spark):
    rows, labels = corpus()
    got = X.score_documents(*frames(spark, rows, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out]
    truth = {i: t for i, _, t in labels}
    assert len(held) > 100
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_labels_of_the_held_out_fold_change_nothing(spark):
    rows, labels = corpus(300)
    docs, lab = frames(spark, rows, labels)
    from pyspark.sql import functions as F

    from weftgraph.llm.labelled import fold

    flipped = lab.withColumn("toxic", F.when(fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r.doc_id, r.score) for r in X.score_documents(docs, x).collect()) for x in (lab, flipped))
    assert a == b


def test_odd_rows_empty_tables_and_one_kind(spark):
    rows, labels = corpus(200)
    docs, lab = frames(spark, rows + [(i + 1000 if i else i, *r) for i, *r in ODD], labels + [(None, 1, 1), (1, 1, 1), (99999, None, None)])
    got = X.score_documents(docs, lab).collect()
    assert len(got) == len(rows) + len(ODD)
    empty = {r.score for r in got if r.doc_id in (1001, 1002, 1003)}
    assert len(empty) == 1 and {r.held_out for r in got if r.doc_id is None} == {False}
    none, no_labels = frames(spark, [], [])
    assert X.score_documents(none, lab).collect() == []
    assert {r.score < 1e-9 for r in X.score_documents(docs, no_labels).collect()} == {True}


def test_drop_keeps_columns(spark):
    rows, labels = corpus(400)
    docs, lab = frames(spark, rows, labels)
    kept = X.drop_toxic(docs.withColumnRenamed("h", "toxicity"), lab)
    assert kept.columns == [c if c != "h" else "toxicity" for c in docs.columns]
    ids = {r.doc_id for r in kept.collect()}
    clean = {i for i, _, t in labels if not t}
    assert len(clean - ids) <= 2 and len(ids - clean) <= 4


def test_scores_are_sums_over_the_features_of_each_text():
    texts = ["a b c", "", None, "B a c grobnik", "x " * 3000]
    lists = [np.frombuffer(x, np.uint32).astype(np.int64) for x in X.feature_lists(pa.array(texts))]
    assert [len(x) for x in lists[:3]] == [3 + 3 + 2 + 1, 0, 0]
    w = X.Weights(np.unique(np.concatenate(lists)), np.random.default_rng(1).normal(size=len(np.unique(np.concatenate(lists)))).astype(np.float32), 0.3)
    dense = w.dense()
    got = X.scores(pa.array(texts), w, dense)
    assert np.allclose(got, [1 / (1 + np.exp(-(dense[x].sum() + 0.3))) for x in lists], atol=1e-5)


def plain_ftrl(lists, labels, alpha, beta, l1, l2, epochs):
    """FTRL-proximal by its published update, coordinate by coordinate."""
    z, n, bz, bn = {}, {}, 0.0, 0.0
    seen = Counter(i for x in lists for i in x)
    rate = lambda v: (beta + math.sqrt(v)) / alpha

    def weight(i):
        v = z.get(i, 0.0)
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / (rate(n.get(i, 0.0)) + l2)

    for _ in range(epochs):
        for x, y in zip(lists, labels):
            x = [i for i in x if seen[i] > 1]
            w, bias = {i: weight(i) for i in x}, -bz / rate(bn)
            g = 1 / (1 + math.exp(-(sum(w.values()) + bias))) - y
            for i in x:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
            bz += g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / alpha * bias
            bn += g * g
    return {i: weight(i) for i in z if weight(i)}, -bz / rate(bn)


def test_training_is_ftrl_proximal():
    r = random.Random(8)
    labels = np.array([i % 3 == 0 for i in range(90)], np.int64)
    lists = [np.array(sorted(r.sample(range(60), 12) + ([70 + r.randrange(3)] if y else [])), np.uint32) for y in labels]
    for l1 in (0.0, 0.5, 3.0):
        got = X.fit(lists, labels, l1=l1)
        want, bias = plain_ftrl([x.tolist() for x in lists], labels.tolist(), X.ALPHA, X.BETA, l1, X.L2, X.EPOCHS)
        assert got.index.tolist() == sorted(want) and abs(got.bias - bias) < 1e-9
        assert np.allclose(got.weight, [want[i] for i in sorted(want)], rtol=1e-5)


def test_the_sample_is_bounded_by_rows_and_bytes_of_documents_that_are_there(spark):
    from weftgraph.llm.labelled import labelled_sample

    docs = documents(spark, [(i, f"text {i}") for i in range(40)] + [(7, f"other {i}") for i in range(30)] + [(7, "text 7")] * 9)
    labels = spark.createDataFrame([(i, i % 2) for i in range(4000, 6000)] + [(i, i % 2) for i in range(40)], "doc_id bigint, toxic int")
    made = lambda b: b.column("text").cast(pa.binary())
    held = {i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 0}
    there = {f"text {i}" for i in range(40) if i not in held} | ({f"other {i}" for i in range(30)} if 7 not in held else set())
    every, _ = labelled_sample(docs, labels, "toxic", 3000, made, 1 << 20)
    assert sorted(x.decode() for x in every) == sorted(there)
    ten, truth = labelled_sample(docs, labels, "toxic", 10, made, 1 << 20)
    assert ten == every[:10] and len(truth) == 10
    few, _ = labelled_sample(docs, labels, "toxic", 3000, made, 50)
    assert few == every[: len(few)] and 50 - 8 <= sum(map(len, few)) <= 50
    assert labelled_sample(docs, labels, "toxic", 3000, made, 3)[0] == []
