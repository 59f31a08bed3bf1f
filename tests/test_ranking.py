"""Row numbers per key over ranges."""

import random

from pyspark.sql import functions as F

from basketry.operators.ranking import numbered


def test_numbers_equal_sorting_and_a_hot_key_is_spread(spark):
    pick = random.Random(3)
    rows = [(pick.choice([None, 1, 1, 1, 1, 1, 1, 1, 2, 3, i]), pick.randint(0, 40), i) for i in range(6000)]
    df = spark.createDataFrame(rows, "k bigint, a int, b bigint").repartition(5)
    got = numbered(df, ["k"], ["a", "b"], "n", ranges=16, group_rows=300)
    want = {}
    for k, a, b in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        want.setdefault(k, []).append((a, b))
    told = got.collect()
    assert len(told) == 6000
    for r in told:
        assert want[r.k][r.n - 1] == (r.a, r.b)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = numbered(df, ["k"], ["a", "b"], "n", ranges=16, group_rows=300).where("k = 1").groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(parts) > 1 and max(r["count"] for r in parts) < 0.9 * sum(r["count"] for r in parts)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_small_keys_take_one_window(spark):
    df = spark.createDataFrame([(i % 3, -i) for i in range(30)], "k bigint, a int")
    assert sorted(r.n for r in numbered(df, ["k"], ["a"], "n").collect()) == sorted([*range(1, 11)] * 3)


def test_empty_table(spark):
    assert numbered(spark.createDataFrame([], "k bigint, a int"), ["k"], ["a"], "n").count() == 0
