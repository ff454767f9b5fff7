import math
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import LONG, ODD, documents, lower
from weftgraph.llm import language_id as L

TEXTS = ["", "a", "Ab cd", "é ü", "x1y2  ZZ!top", "漢字\U0001f600 ok", " lead and trail ", "no-letters 123"]


def grams(text):
    """The runs of one to MOST characters of words between marks, by a plain loop."""
    out, word = [], []
    for c in lower(text).lower() + " ":
        if c.isascii() and not c.isalpha():
            if word:
                marked = ["^", *word, "^"]
                out += word
                out += [tuple(marked[i : i + k]) for k in range(2, L.MOST + 1) for i in range(len(marked) - k + 1)]
            word = []
        else:
            word.append(c)
    return out


def test_features_are_runs_of_characters():
    """As many as plain runs, equal features for equal runs, each row its own."""
    seen, n = {}, 0
    rows = [x for x in TEXTS * 3 + [LONG[:5000]]]
    for first, found, ptr in L.features(pa.array(rows), 30):
        for i in range(len(ptr) - 1):
            own, plain = Counter(found[ptr[i] : ptr[i + 1]].tolist()), Counter(grams(rows[first + i]))
            assert sorted(own.values()) == sorted(plain.values()), rows[first + i]
            assert seen.setdefault(rows[first + i], own) == own
            n += 1
    assert n == len(rows)
    for a in TEXTS:
        for b in TEXTS:
            assert sum((seen[a] & seen[b]).values()) == sum((Counter(grams(a)) & Counter(grams(b))).values())


def test_slices_do_not_matter(monkeypatch):
    whole = list(L.features(pa.array(TEXTS), 16))
    monkeypatch.setattr(L, "words", lambda *a: words_(*a, slice_bytes=4))
    parts = list(L.features(pa.array(TEXTS), 16))
    assert len(parts) > len(whole) == 1
    assert np.array_equal(np.concatenate([f for _, f, _ in parts]), whole[0][1])


words_ = L.words


def plain(rows):
    """Predictions and scores by dictionaries of counts, for texts whose features don't collide."""
    learn = [(t or "", g) for i, t, g in rows if i is not None and g is not None and zlib.crc32(str(i).encode()) % 3 != 1]
    number = {}
    hashed = lambda t: [x for _, found, _ in L.features(pa.array([t]), L.BITS) for x in found.tolist()]
    counts = defaultdict(Counter)
    for t, g in learn:
        counts[g].update(hashed(t))
        number[g] = number.get(g, 0) + 1
    out = {}
    for i, t, _ in rows:
        if not t or not any(unicodedata.category(c)[0] == "L" for c in t) or not number:
            out[i] = ("und", 0.0)
            continue
        logs = {}
        for g in sorted(number):
            total = sum(counts[g].values()) + L.SMOOTHING * (1 << L.BITS)
            logs[g] = math.log(number[g] / len(learn)) + sum(math.log((counts[g][x] + L.SMOOTHING) / total) for x in hashed(t))
        best = max(sorted(logs), key=logs.get)
        out[i] = (best, 1 / sum(math.exp(v - logs[best]) for v in logs.values()))
    return out


def frame(spark, rows):
    return documents(spark, [(i, t) for i, t, _ in rows]).drop("lang").join(spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id bigint, lang string"), "doc_id")


def test_by_plain_counts(spark):
    rows = [(i, f"{'the and of' if i % 2 else 'der und zu'} {i}{'en ' * (i % 5)}", None if i % 9 == 0 else "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, "", "en"), (101, None, "de"), (102, "123 !?", "en"), (103, "—", None), (104, "und", None), (105, LONG, "xx"), (106, "the der", ""), (107, "漢字", None)]
    got = {r.doc_id: r for r in L.identify(frame(spark, rows)).collect()}
    want = plain(rows)
    assert got.keys() == want.keys()
    for i, (lang, score) in want.items():
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(score, abs=1e-4), i
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_held_out_rows_teach_nothing(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 == 1]
    rows = [(i, "der die das", "xx" if i in held else "de") for i in range(200)]
    assert {r.lang_pred for r in L.identify(frame(spark, rows)).collect()} == {"de"}


def test_odd_rows_and_nothing_to_learn(spark):
    got = L.identify(documents(spark, ODD))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == len(ODD)
    assert {(r.lang_pred, r.score) for r in L.identify(documents(spark, ODD).withColumn("lang", F.lit(None).cast("string"))).collect()} == {("und", 0.0)}
    assert L.identify(documents(spark, [])).collect() == []


def test_many_languages_get_fewer_bits_and_too_many_are_refused(spark, monkeypatch):
    rows = [(i, f"word{chr(97 + i % 26) * 9}", chr(97 + i % 26)) for i in range(300)]
    monkeypatch.setattr(L, "CELLS", 1 << 14)
    model = L.train(frame(spark, rows), F.lit(True))
    assert model.bits == 9 and len(model.langs) == 26
    found = L.guess(frame(spark, rows), model).join(frame(spark, rows).select("doc_id", "lang"), "doc_id")
    assert found.filter("lang = lang_pred").count() > 250
    monkeypatch.setattr(L, "MAX_LANGS", 20)
    with pytest.raises(ValueError):
        L.train(frame(spark, rows), F.lit(True))


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    judged = L.identify(docs).filter("held_out").join(docs, "doc_id")
    assert judged.filter("lang = lang_pred").count() >= 0.97 * judged.count()
