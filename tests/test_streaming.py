"""Streams: state over restarts, hot keys, batches seen whole, late rows, open windows."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from basketry.operators import insights as I
from basketry.plans import live
from basketry.session import scratch_path
from basketry.streaming import counters, manifest
from basketry.streaming import insights as SI

EVENTS = ("event_id string, event_type string, customer_id string, product_id string, product_name string, category string, "
          "quantity int, revenue double, event_time timestamp, seq bigint")
START = dt.datetime(2024, 1, 1)


def events(spark, first, last, step=37, **fixed):
    """Events ``first`` to ``last`` - 1; two thirds of them in one category and of one customer."""
    rows = []
    for i in range(first, last):
        row = {"event_id": f"e{i}", "event_type": "purchase" if i % 3 else "view", "customer_id": f"c{i % 5}" if i % 3 == 0 else "c-hot",
               "product_id": None if i % 4 == 0 else f"p{i}", "product_name": None, "category": "hot" if i % 3 else f"k{i % 4}", "quantity": None if i % 6 == 0 else i % 4,
               "revenue": None if i % 10 == 0 else i * 1.25, "event_time": START + dt.timedelta(seconds=step * i, microseconds=i), "seq": i}
        rows.append(tuple((row | fixed)[c.split()[0]] for c in EVENTS.split(", ")))
    return spark.createDataFrame(rows, EVENTS)


def fresh(spark):
    return scratch_path(spark, f"streams-{uuid.uuid4().hex[:8]}")


def normalised(spark, source, **options):
    reader = spark.readStream.schema(EVENTS)
    for k, v in options.items():
        reader = reader.option(k, v)
    return I.normalize_stream(reader.parquet(source))


def rows(df):
    return sorted((tuple(r) for r in df.select("event_id", "insight_ordinal", "kind", "title", "detail", "severity").collect()))


def test_counts_go_on_after_a_restart(spark):
    """Three files in two runs of two batches and one: the same as one batch job."""
    base, source = fresh(spark), fresh(spark)
    for part in (events(spark, 0, 90), events(spark, 90, 200)):
        part.coalesce(1).write.mode("append").parquet(source)
    counters.run(normalised(spark, source, maxFilesPerTrigger=1), base)
    assert len(manifest.complete_batches(spark, base)) >= 2
    events(spark, 200, 260).coalesce(1).write.mode("append").parquet(source)
    counters.run(normalised(spark, source, maxFilesPerTrigger=1), base)
    everything = I.normalize_stream(events(spark, 0, 260))
    assert rows(live.sink(spark, base, "insights")) == rows(I.detect_insights(I.with_counters(everything)))
    assert live.sink(spark, base, "events").count() == 260
    counters.run(normalised(spark, source, maxFilesPerTrigger=1), base)  # nothing new
    assert live.sink(spark, base, "events").count() == 260


def test_a_hot_key_is_spread(spark):
    """Tasks send sub-totals of a key, and its events go to many buckets."""
    told = counters.sub_totals(I.normalize_stream(events(spark, 0, 1000).repartition(3))).toPandas()
    hot = told[(told.counter == "category") & (told.key == "hot")]
    assert len(hot) <= 3 and hot["add"].sum() == 666
    assert told[told.counter == "event"].key.nunique() > counters.BUCKETS // 2


def test_an_unfinished_batch_is_not_seen(spark):
    base = fresh(spark)
    one, two = spark.range(3).select("id"), spark.range(3, 9).select("id")
    manifest.write_batch(base, 0, {"a": one, "b": one})
    two.write.parquet(f"{base}/a/batch_id=1")  # the second table and the mark are missing
    assert sorted(r.id for r in manifest.read_complete(spark, base, "a", "id long").collect()) == [0, 1, 2]
    manifest.write_batch(base, 1, {"a": two, "b": two})
    manifest.write_batch(base, 1, {"a": two, "b": two})
    assert manifest.read_complete(spark, base, "a", "id long").count() == 9 == manifest.read_complete(spark, base, "b", "id long").count()
    assert manifest.read_complete(spark, fresh(spark), "a", "id long").count() == 0


def test_open_windows_and_late_rows(spark):
    base, source = fresh(spark), fresh(spark)
    hours = events(spark, 0, 40, step=600)

    def stream():
        return spark.readStream.schema(EVENTS).parquet(source)

    hours.coalesce(1).write.mode("append").parquet(source)
    SI.run_hourly(stream(), base)
    # one row long behind the watermark, one that is not
    events(spark, 500, 501, event_time=START).unionByName(events(spark, 501, 502, event_time=START + dt.timedelta(hours=6, minutes=30))).coalesce(1).write.mode("append").parquet(source)
    windows, late = SI.run_hourly(stream(), base)
    kept = hours.unionByName(events(spark, 501, 502, event_time=START + dt.timedelta(hours=6, minutes=30)))
    want = SI.hourly_revenue(kept, delay=None)
    got = windows.select("window_start", "event_type", "revenue", "events")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    flags = {r.is_open for r in windows.select("is_open").distinct().collect()}
    assert flags == {True, False}
    assert late.agg(F.sum("dropped")).first()[0] == 1

