"""Function-level operators not covered by a registered query."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from basketry.operators import cleaning, topk, upserts
from basketry.plans import live
from basketry.plans.queries import views
from basketry.session import scratch_path
from basketry.streaming import topics
from tests.conftest import SF_SMALL


def test_drain_hands_over_each_row_once(spark):
    base = scratch_path(spark, f"drain-test-{uuid.uuid4().hex[:8]}")
    src = f"{base}/src"
    schema = "id long, v string"
    spark.createDataFrame([(1, "a"), (2, "b")], schema).write.parquet(src, mode="append")
    stream = spark.readStream.schema(schema).parquet(src)
    first = topics.drain(spark, stream, f"{base}/ckpt", f"{base}/out")
    assert sorted(r.id for r in first.collect()) == [1, 2]
    spark.createDataFrame([(3, "c")], schema).write.parquet(src, mode="append")
    second = topics.drain(spark, spark.readStream.schema(schema).parquet(src), f"{base}/ckpt", f"{base}/out")
    assert [r.id for r in second.collect()] == [3]
    third = topics.drain(spark, spark.readStream.schema(schema).parquet(src), f"{base}/ckpt", f"{base}/out")
    assert third.count() == 0


def test_newest_per_key(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2), ("a", 2)], "k string, t int")
    got = {r.k: r.t for r in topk.newest_per_key(df, ["k"], [F.desc("t")]).collect()}
    assert got == {"a": 3, "b": 2}


def test_insert_once_touch(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("p1", "first", t0), ("p1", "second", t0 + dt.timedelta(days=1)), ("p2", "only", t0)],
                               "id string, name string, updated_at timestamp")
    got = {r.id: (r.name, r.updated_at) for r in upserts.insert_once_touch(df, ["id"]).collect()}
    assert got["p1"] == ("first", t0 + dt.timedelta(days=1)) and got["p2"][0] == "only"


def test_unique_enforcement_splits(spark):
    df = spark.createDataFrame([("k1", 1), ("k1", 2), ("k2", 1)], "k string, o int")
    acc, rej = upserts.enforce_unique(df, ["k"], "o")
    assert sorted(tuple(r) for r in acc.collect()) == [("k1", 1), ("k2", 1)]
    assert [tuple(r) for r in rej.collect()] == [("k1", 2)]


def test_review_and_browse_validation(spark):
    r = spark.createDataFrame([("cust-1", 5, "great"), ("c", 9, "ok")], "customer_id string, rating int, text string")
    got = [(x.is_valid, x.reasons) for x in cleaning.validate_reviews(r).collect()]
    assert got == [(True, []), (False, ["customer_id_length", "rating_range", "text_length"])]
    b = spark.createDataFrame([("cust-1", 10), ("cust-2", 4000)], "customer_id string, dwell_seconds int")
    assert [x.is_valid for x in cleaning.validate_browse(b).collect()] == [True, False]


def test_live_snapshot_parts(spark):
    from basketry.operators import insights as I
    norm = I.normalize_stream(views(spark, SF_SMALL).stream_events())
    ins = I.detect_insights(I.with_counters(norm))
    snap = live.live_snapshot(norm, ins)
    assert snap["recent_events"].count() == 30 and snap["recent_insights"].count() == 30
    assert snap["events_seen"].first().events_seen == norm.count()
    assert snap["top_categories"].count() == 5
