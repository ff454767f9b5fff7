"""The pipeline's stages on a small table, against plain models of each."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.helpers import ODD, words


def tables(spark, tmp_path):
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(2000)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    rows, kind = [], {}
    add = lambda t, k: (kind.setdefault(len(rows), k), rows.append((len(rows), t, "en", f"s{len(rows) % 3}" if len(rows) % 7 else None, len(t))))
    for i in range(240):
        add(text(60) + (" grobnik snarfle grobnik" if i % 6 == 0 else ""), "toxic" if i % 6 == 0 else "clean")
    items = [(i, text(30)) for i in range(5)]
    for i in range(5):
        add(text(20) + " " + items[i][1] + " " + text(20), "leak")
    for i in range(1, 20, 6):
        add(rows[i][1], "copy")
        near = rows[i][1].split()
        near[0] = "changed"
        add(" ".join(near), "near")
    docs = rows + [(i + 1000 if i else i, t, None, None, None) for i, t, *_ in ODD if i != 7]
    labels = [(i, 1, int(kind[i] == "toxic")) for i in range(240)]
    at = str(tmp_path / "sf")
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, kind


def test_stages_one_after_the_other(spark, tmp_path):
    at, kind = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns, left = docs.columns, []
    for i, (name, step) in enumerate(P.STAGES):
        docs = step(spark, docs, at)
        docs.write.parquet(f"{at}/stage{i}")
        docs = spark.read.parquet(f"{at}/stage{i}")
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
            left.append({r.doc_id for r in docs.select("doc_id").collect()})
    of = lambda k: {i for i, x in kind.items() if x == k}
    gone = [set(kind) - x for x in left]
    assert gone[0] == of("toxic") | (gone[0] & of("near")) and not gone[0] & of("clean")
    assert gone[1] - gone[0] == of("copy") and not gone[1] & of("clean")
    assert gone[2] - gone[1] == of("near") - gone[0] and not gone[2] & of("clean")
    assert gone[3] - gone[2] == of("leak") and not gone[3] & of("clean")
    rows = docs.collect()
    assert {r.doc_id for r in rows} <= left[3] and all(r.copies in (1, 2) and r.taken == r.copies * r.size for r in rows)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{at}/stage3").collect()}
    total = sum(len(words(t)) for t in texts.values())
    assert abs(sum(r.taken for r in rows) - 1.5 * total) < 400
    again = {(r.doc_id, r.copies) for r in P.run(spark, at).collect()}
    assert again == {(r.doc_id, r.copies) for r in rows}


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    """Nulls, long and repeated texts, columns whose names and types stages use inside, and tables without rows."""
    at = str(tmp_path / "sf")
    spark.createDataFrame([(3, 1, 1), (None, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight"), (2, None)], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    rows = [(*r, None)[:3] if len(r) == 2 else r for r in ODD]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    clash = {n: F.lit(n) for n in ("row", "h", "t", "key", "class", "leak", "toxicity", "n_chars", "text key", "text is null", "size")}
    docs = docs.withColumns(clash).withColumn("m", F.create_map(F.lit("k"), "doc_id")).withColumn("lang", F.array(F.create_map(F.lit("k"), "text")))
    for name, part, left in (("odd", docs, 6), ("none", docs.limit(0), 0)):
        for i, (stage, step) in enumerate(P.STAGES):
            out = step(spark, part, at)
            if i < len(P.STAGES) - 1:
                assert out.schema.simpleString() == docs.schema.simpleString(), stage
            out.write.parquet(f"{at}/{name}{i}")
            part = spark.read.parquet(f"{at}/{name}{i}")
            if i == 3:
                assert sorted(str(r.doc_id) for r in part.collect()) == ([] if not left else ["1", "3", "4", "5", "7", "8"]), stage
        assert (part.count() > 0) == bool(left)


def test_names_and_order():
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing"]
    assert P.ORACLE_SQL is None
