import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from tests.llm.helpers import ODD, documents
from weftgraph.llm.exact_dedup import exact_dedup, keep_one


def check(rows, got, best):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    assert len(got) == len(rows)
    by_text = defaultdict(list)
    for r in got:
        by_text[r.text_sha256].append(r)
    for t, ids in groups.items():
        found = by_text[hashlib.sha256(t.encode()).hexdigest()]
        assert sorted((r.doc_id for r in found), key=str) == sorted(ids, key=str)
        assert {r.group_size for r in found} == {len(ids)}
        keep = best((i for i in ids if i is not None), default=None)
        assert {r.keep_id for r in found} == {keep}
        assert [r.doc_id for r in found if r.kept] == [keep]


def test_groups_by_brute_force(spark):
    rows = ODD + [(i, f"t{i % 7}") for i in range(100, 160)]
    for keep, best in (("largest", max), ("smallest", min)):
        check(rows, exact_dedup(documents(spark, rows), keep).collect(), best)


def test_bytes_part_texts_whose_hashes_collide(spark):
    rows = ODD + [(i, f"t{i % 7}") for i in range(100, 160)]
    weak = lambda t: F.unhex(F.lpad(F.substring(F.md5(t), 1, 1), 2, "0"))
    check(rows, exact_dedup(documents(spark, rows), "largest", weak).collect(), max)


def test_texts_whose_hashes_are_too_many_to_send(spark, monkeypatch):
    from weftgraph.llm import exact_dedup as E

    monkeypatch.setattr(E, "SENT_HASHES", 0)
    rows = ODD + [(i, f"t{i % 7}") for i in range(100, 160)]
    weak = lambda t: F.unhex(F.lpad(F.substring(F.md5(t), 1, 1), 2, "0"))
    check(rows, exact_dedup(documents(spark, rows), "largest", weak).collect(), max)


def test_empty_table(spark):
    assert exact_dedup(documents(spark, [])).collect() == []
    assert keep_one(documents(spark, [])).collect() == []


def test_keep_one_keeps_columns_and_one_row_of_each_text(spark):
    docs = documents(spark, ODD)
    got = keep_one(docs)
    assert got.columns == docs.columns
    texts = [r.text or "" for r in got.collect()]
    assert sorted(texts) == sorted({t or "" for _, t, *_ in ODD})
    assert {r.doc_id for r in got.filter("text = 'same text here'").collect()} == {5}


def test_keep_one_takes_columns_without_an_order(spark):
    docs = documents(spark, ODD).withColumn("m", F.create_map(F.lit("a"), F.col("doc_id"))).withColumn("s", F.struct(F.col("m").alias("doc_id"), "lang")).withColumn("row.x", F.array("m"))
    for keep in ("smallest", "largest"):
        got = keep_one(docs, keep)
        assert got.schema.simpleString() == docs.schema.simpleString()
        rows = got.collect()
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in keep_one(documents(spark, ODD), keep).collect())
        assert all(r.m == {"a": r.doc_id} for r in rows)


def test_batch_setting_in_any_unit(spark):
    from weftgraph.llm.batches import BATCH_BYTES, bounded

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    for value, after in (("4m", "4m"), ("64m", f"{BATCH_BYTES}b"), ("1048576", "1048576")):
        spark.conf.set(key, value)
        bounded(spark.range(1))
        assert spark.conf.get(key) in (after, after + "b")
    spark.conf.set(key, was)
