from collections import defaultdict

from weftgraph.ordered import MODULUS, within_keys


def test_places_and_sums_of_groups_over_many_tasks(spark):
    """Keys that fill several tasks, keys of one row, nulls in the order and ties, by a plain loop."""
    rows = [("hot", None if i < 3 else i // 2, (1 << 32) - 1 - i) for i in range(700)] + [(f"k{i % 40}", i, i) for i in range(200)]
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for parts in ("7", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            made = within_keys(spark.createDataFrame(rows, "key string, at bigint, x bigint").withColumnRenamed("x", "n").selectExpr("key", "at", "n", "n as total"), "key", ["at", "n"], "t", ("total",)).collect()
            want, got = defaultdict(list), defaultdict(list)
            for k, at, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
                want[k].append((len(want[k]), x, ((want[k][-1][2] if want[k] else 0) + x) % MODULUS))
            for r in made:
                got[r.key].append((r.place, r.n, r.total))
            assert {k: sorted(v) for k, v in got.items()} == dict(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)


def test_empty(spark):
    assert within_keys(spark.createDataFrame([], "key string, at bigint"), "key", ["at"], "t").collect() == []
