"""Running insight counters of a stream in Spark's own state (ST2, ST4).

How often a category was seen, and how often a customer bought, up to and with
each event, over all micro-batches:

* tasks add up their rows of a key before anything is shuffled, so that the
  state operator (``applyInPandasWithState``, one value per counter and key in
  RocksDB, which comes and goes with the key's rows) receives sub-totals: a few
  rows even of a key that every event has.  It keeps the total and tells the
  one before the batch;
* the events pass it in buckets by id, on their way to the batch function, which
  ranks them within the batch (``operators.running``, no key in one task) and
  adds the total before.

Events, insights and nothing else are written per batch under one manifest
(``streaming.manifest``); state and offsets are Spark's checkpoint, so a batch that
is run again starts from the same totals and rewrites the same folders.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from basketry.operators.insights import detect_insights
from basketry.operators.running import running_count, time_bucket
from basketry.streaming.manifest import write_batch

#: (key column, name of the count, the event type that counts or all)
COUNTERS = (("category", "category_count", None), ("customer_id", "customer_purchases", "purchase"))
BUCKETS = 64
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PASSED = "counter string, key string, add bigint, payload string"
_TOLD = "counter string, key string, before bigint, payload string"


def sub_totals(norm: DataFrame) -> DataFrame:
    """(counter, key, add, payload): every event as a row of counter 'event' in one
    of ``BUCKETS`` keys, and per counter and key one row for each Arrow batch."""
    event = norm.withColumn("event_time", F.unix_micros("event_time"))
    staged = event.select(
        F.to_json(F.struct(*event.columns)).alias("payload"), F.pmod(F.xxhash64("event_id", "seq"), F.lit(BUCKETS)).cast("string").alias("bucket"),
        *(F.col(key) for key, _, _ in COUNTERS),
        *(F.when(F.col("event_type") == only, 1).otherwise(0).cast("bigint").alias(f"add_{key}") if only else F.lit(1).cast("bigint").alias(f"add_{key}")
          for key, _, only in COUNTERS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(counter: str, keys, adds, payloads) -> pa.RecordBatch:
            n = len(keys)
            return pa.RecordBatch.from_arrays([pa.array([counter] * n, pa.string()), keys.cast(pa.string()), adds.cast(pa.int64()), payloads],
                                              names=["counter", "key", "add", "payload"])

        for batch in batches:
            yield rows("event", batch.column("bucket"), pa.array([0] * batch.num_rows, pa.int64()), batch.column("payload").cast(pa.string()))
            for key, _, _ in COUNTERS:
                sums = pa.table({"key": batch.column(key), "add": batch.column(f"add_{key}")}).group_by("key").aggregate([("add", "sum")]).combine_chunks()
                for part in sums.to_batches():
                    yield rows(key, part.column("key"), part.column("add_sum"), pa.nulls(part.num_rows, pa.string()))

    return staged.mapInArrow(run, _PASSED)


def totals(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Per counter and key: the total so far, told if there was one before the
    batch.  Rows of counter 'event' pass."""
    if key[0] == "event":
        for part in rows:
            yield part[["counter", "key", "payload"]].assign(before=0)[["counter", "key", "before", "payload"]]
        return
    before = state.get[0] if state.exists else 0
    state.update((before + sum(int(part["add"].sum()) for part in rows),))
    if before:  # a key that is new has nothing to tell
        yield pd.DataFrame({"counter": [key[0]], "key": [key[1]], "before": [before], "payload": pd.Series([None], dtype=object)})


def carried(norm: DataFrame) -> DataFrame:
    """The stream's events and, per batch, the total before it of each key seen before.  Totals are
    for all time (trap T9), so the state has no time to live."""
    return sub_totals(norm).groupBy("counter", "key").applyInPandasWithState(totals, _TOLD, "n bigint", "append", GroupStateTimeout.NoTimeout)


def counted_batch(batch: DataFrame, event_schema) -> tuple[DataFrame, DataFrame]:
    """(events, events with both running counts) of a batch of ``carried``."""
    fields = [f"{f.name} {'bigint' if f.name == 'event_time' else f.dataType.simpleString()}" for f in event_schema]
    parsed = batch.where("counter = 'event'").select(F.from_json("payload", ", ".join(fields)).alias("e")).select("e.*")
    events = parsed.withColumn("event_time", F.timestamp_micros("event_time"))
    counted = events
    for key, name, only in COUNTERS:
        start = batch.where(F.col("counter") == key).select(F.col("key").alias(key), F.col("before").alias("start"))
        counted = running_count(counted, [key], ["event_time", "seq"], time_bucket(F.col("event_time")), name,
                                (F.col("event_type") == only) if only else None, start)
    return events, counted


def run(norm: DataFrame, base: str):
    """Drains the normalised stream into ``base`` (tables events and insights) and
    returns the ended query.  Run again, it goes on where it stopped."""
    norm.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    schema = norm.schema

    def batch_function(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()  # read by the totals, both counters and the sinks
        try:
            events, counted = counted_batch(held, schema)
            write_batch(base, batch_id, {"events": events, "insights": detect_insights(counted)})
        finally:
            held.unpersist()

    query = (carried(norm).writeStream.option("checkpointLocation", f"{base}/checkpoint")
             .foreachBatch(batch_function).trigger(availableNow=True).start())
    query.awaitTermination()
    return query
