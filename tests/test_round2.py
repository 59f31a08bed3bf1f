"""Cases that the fixture tables lack: odd time texts, ties, uncut series."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from basketry.functions.text import currency_label, percent_label
from basketry.functions.timefn import parse_utc_timestamp
from basketry.operators import baskets, featurejson, forecasting, graph, lookup, recommend, reviews, segmentation


def test_times_without_a_whole_date_are_rejected(spark):
    texts = ["10:15:00", "T10:15:00", "2024", "2024-01", "2024-01-05", "2024-01-05T10:15:00Z", " 2024-01-05 10:15:00+01:00 ", "2024-13-05"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.unix_timestamp(parse_utc_timestamp(F.col("t"))).alias("s")).collect()
    midnight = 1704412800
    assert [r.s for r in rows] == [None, None, None, None, midnight, midnight + 36900, midnight + 33300, None]


def test_reviews_without_product_do_not_mix_with_the_overall_rows(spark):
    scored = spark.createDataFrame([(1, "positive"), (1, "negative"), (None, "positive")], "product_id bigint, label string")
    rows = sorted((r.product_id or 0, r.label, r.review_count, r.share) for r in reviews.sentiment_mix(scored).collect())
    assert rows == [(0, "negative", 1, 0.333), (0, "positive", 1, 1.0), (0, "positive", 2, 0.667), (1, "negative", 1, 0.5), (1, "positive", 1, 0.5)]


def test_scalar_features_keep_strings_that_look_nested(spark):
    text = '{"a":"[vip]","b":"{x","c":[1],"d":{"e":1},"f":null,"g":1,"h":true,"i":2.5}'
    got = featurejson.scalar_only(spark.createDataFrame([(text,)], "features_json string")).first().features
    assert got == {"a": "[vip]", "b": "{x", "g": "1", "h": "true", "i": "2.5"}


def test_labels_round_half_to_even(spark):
    rows = spark.createDataFrame([(2.5,), (3.5,), (18420.4,)], "v double").select(currency_label(F.col("v")).alias("c")).collect()
    assert [r.c for r in rows] == ["$2", "$4", "$18,420"]
    rows = spark.createDataFrame([(0.125,), (12.25,), (12.35,)], "v double").select(percent_label(F.col("v")).alias("p")).collect()
    assert [r.p for r in rows] == ["12.5%", "12.2%", "12.3%"]


def test_k_is_clamped_to_the_rows(spark):
    features = spark.createDataFrame([(i, float(i), float(i % 3), float(i * 10)) for i in range(5)], "customer_id bigint, recency_days double, frequency double, monetary_value double")
    for k, clusters in ((1, 2), (3, 3), (50, 5)):
        model = segmentation.fit_kmeans(features, k)
        assert len(model.centers) == clusters
        assert segmentation.assign(model, features).count() == 5


def test_long_series_are_not_cut(spark):
    day = dt.datetime(2024, 1, 1, 12)
    orders = spark.createDataFrame([(1, day + dt.timedelta(days=i), float(i)) for i in range(60)], "customer_id bigint, created_at timestamp, revenue double")
    series = forecasting.revenue_series(orders)
    assert series.count() == 60
    assert forecasting.revenue_forecast(series).first().points == 60
    weighted = forecasting.weighted_revenue_forecast(series).first()
    mean = sum(i * (i + 1) for i in range(60)) / sum(range(1, 61))
    assert weighted.prediction == round(mean + 0.35, 2)


def test_recommendations_over_a_large_catalog(spark):
    n = 6000
    catalog = spark.range(n).select(
        F.col("id").alias("product_id"), F.col("id").alias("ordinal"), F.concat(F.lit("p"), "id").alias("product"),
        F.array(F.concat(F.lit("cat"), (F.col("id") % 50).cast("string"))).alias("categories"), F.array(F.lit("word")).alias("keywords"),
        (F.lit(0.5) + F.col("id") / (4 * n)).alias("base_score"))
    rows = [(i, "Active shopper", [f"cat{i % 7}"]) for i in range(40)] + [(99, "Active shopper", None)]
    customers = spark.createDataFrame(rows, "customer_id bigint, segment string, recent_categories array<string>")
    got = recommend.recommend(customers, catalog, k=3)
    assert "collect_list(struct(ordinal" not in got._jdf.queryExecution().executedPlan().toString()
    told = got.collect()
    assert len(told) == 3 * 41
    for r in told:
        if r.customer_id < 99:
            assert r.category == f"cat{r.customer_id % 7}" and r.product_id > n - 400


def test_frequent_pairs_equal_filtered_pairs(spark):
    rows = [(b, p) for b in range(30) for p in range(25) if (b * p + b) % 3 == 0]
    table = spark.createDataFrame(rows, "basket bigint, product bigint")
    pairs = lambda df: {(r.left, r.right, r.pair_count) for r in df.collect()}
    assert pairs(baskets.frequent_pairs(table, 9)) == pairs(baskets.pair_counts(table, block=4).filter("pair_count >= 9"))


def test_bounded_lookup_side_is_broadcast(spark):
    spark_conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = spark.createDataFrame([(1, "x"), (None, "y"), (7, "z")], "pid bigint, other string")
        products = spark.createDataFrame([(1, "one"), (2, "two")], "id bigint, name string")
        got = lookup.with_product_name(few, products, "pid", "name", small_side=True)
        assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.name for r in got.collect()) == ["7", "Unknown product", "one"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", spark_conf)


def test_unset_folder_on_a_cluster_is_an_error():
    from basketry.session import checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())


def test_all_edges_are_returned(spark):
    from basketry.plans.queries import QUERIES
    rows = QUERIES["graph_edges"](spark, "/root/testdata/sf0.001").groupBy("customer_id").count().agg(F.max("count")).first()
    assert rows[0] > 14


def test_running_counts_of_one_hot_key_and_hour(spark):
    from basketry.operators.running import running_count, time_bucket
    start = dt.datetime(2024, 1, 1, 5)
    rows = [(None if i % 50 == 0 else "one", start + dt.timedelta(milliseconds=700 * i), i) for i in range(2000)]
    events = spark.createDataFrame(rows, "category string, event_time timestamp, seq bigint").repartition(4)
    counted = running_count(events, ["category"], ["event_time", "seq"], time_bucket(F.col("event_time")), "n")
    got = {r.seq: r.n for r in counted.collect()}
    seen = {}
    for category, _, seq in rows:
        seen[category] = seen.get(category, 0) + 1
        assert got[seq] == seen[category]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert counted.groupBy(F.spark_partition_id()).count().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_pairs_as_numbers_equal_the_join(spark):
    rows = [(b, f"p{p}") for b in range(40) for p in range(33) if (b * p + b) % 3 == 0] + [(99, f"p{p}") for p in range(60)]
    table = spark.createDataFrame(rows, "basket bigint, product string").repartition(3)
    pairs = lambda df: sorted((r.left, r.right, r.pair_count) for r in df.collect())
    for least in (1, 6):
        for block in (7, 1000):
            assert pairs(baskets.frequent_pair_counts(table, least, block)) == pairs(baskets.pair_counts(table, block=4).filter(F.col("pair_count") >= least))
    assert baskets.frequent_pair_counts(spark.createDataFrame([], "basket bigint, product string"), 1).count() == 0
