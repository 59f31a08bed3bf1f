"""Streaming de-duplication and windowed revenue (ST5, ST6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.streaming.counters import ROCKSDB


def dedupe(stream: DataFrame, key: str = "event_id", ts: str = "event_time", delay: str = "1 day") -> DataFrame:
    """ST5: one row per event id (duplicate deliveries within the watermark)."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def hourly_revenue(stream: DataFrame, delay: str | None = "1 hour") -> DataFrame:
    """ST6: revenue per hour and event type; in append mode a window appears
    when the watermark closes it.  Pass ``delay=None`` when the stream already
    carries a watermark (e.g. after ``dedupe``)."""
    s = stream.withWatermark("event_time", delay) if delay else stream
    return (s.groupBy(F.window("event_time", "1 hour").alias("w"), "event_type")
                  .agg(F.sum(F.col("revenue").cast("decimal(18,2)")).alias("revenue"), F.count(F.lit(1)).alias("events"))
                  .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type",
                          F.col("revenue").cast("double").alias("revenue"), "events"))


def open_windows(spark: SparkSession, checkpoint: str, operator_id: int = 0) -> DataFrame:
    """The windows of ``hourly_revenue`` that no watermark has closed, from the
    state that the stream's checkpoint holds after its last batch."""
    state = spark.read.format("statestore").option("operatorId", operator_id).load(checkpoint)
    key = [f"key.`{f.name}`" for f in state.schema["key"].dataType.fields]
    held = [f"value.`{f.name}`" for f in state.schema["value"].dataType.fields]
    # sum keeps (sum, isEmpty), count keeps (count)
    return state.select(F.col(f"{key[0]}.start").alias("window_start"), F.col(f"{key[0]}.end").alias("window_end"), F.col(key[1]).alias("event_type"),
                        F.col(held[0]).cast("decimal(18,2)").cast("double").alias("revenue"), F.col(held[-1]).alias("events"))


def run_hourly(stream: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """Drains ``stream`` through ``dedupe`` and ``hourly_revenue``: (all windows seen so
    far with ``is_open``, rows that came behind the watermark by run, batch and
    operator).  Closed windows are in the sink, open ones in the state; a row
    behind the watermark changes neither and is counted in the table ``late``."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "100000")
    windows = hourly_revenue(dedupe(stream, delay="1 hour"), delay=None)
    query = run_to_table(windows, f"{base}/closed", f"{base}/checkpoint")
    rows = [(str(query.runId), int(p["batchId"]), name, int(op["numRowsDroppedByWatermark"])) for p in query.recentProgress
            for name, op in zip(("hourly_revenue", "dedupe"), p["stateOperators"]) if op["numRowsDroppedByWatermark"]]
    schema = "run string, batch_id bigint, operator string, dropped bigint"
    spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{base}/late")
    closed = spark.read.schema(windows.schema).parquet(f"{base}/closed")
    both = closed.withColumn("is_open", F.lit(False)).unionByName(open_windows(spark, f"{base}/checkpoint").withColumn("is_open", F.lit(True)))
    return both, spark.read.schema(schema).parquet(f"{base}/late")


def run_to_table(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append"):
    """Run a streaming frame over all available input into a parquet table.
    The file sink logs each batch, so one that is run again is not doubled."""
    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
         .format("parquet").option("path", sink).trigger(availableNow=True).start())
    q.awaitTermination()
    return q
