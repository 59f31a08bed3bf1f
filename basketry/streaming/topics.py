"""Topic source and sink.

Production reads ``format("kafka")`` with ``subscribe`` on the two topics; the
same decoding runs on any frame, streaming or not, with the Kafka column names
(topic, value, offset), such as events encoded on the way (``encode``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.session import path_exists, scratch_path

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("order_id", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("product_id", T.StringType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("quantity", T.LongType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("revenue", T.DoubleType()),
    T.StructField("event_time", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("_corrupt", T.StringType()),
])


def encode(events: DataFrame, topics: list[str], only_purchases_for: set[str] | None = None) -> DataFrame:
    """Each event as a JSON payload, once per topic.

    ``only_purchases_for`` names topics that carry purchase events only
    (the reference publishes each purchase to both of its topics)."""
    payload = F.to_json(F.struct(*[F.col(c) for c in events.columns]),
                        {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    only = only_purchases_for or set()
    topic_list = F.array(*[F.when(F.lit(t not in only) | (F.col("event_type") == "purchase"), F.lit(t)) for t in topics])
    return (events.select(payload.alias("value"), F.col("seq").cast("long").alias("offset"),
                          F.explode(F.array_compact(topic_list)).alias("topic"))
                  .select("topic", "value", "offset"))


def kafka_topic_stream(spark: SparkSession, bootstrap_servers: str, topics: list[str],
                       max_offsets_per_trigger: int | None = None) -> DataFrame:
    """S7 in production: the two shop topics from Kafka, projected to the
    (topic, value, offset) columns that ``decode`` takes.
    Needs the spark-sql-kafka connector on the classpath."""
    reader = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", bootstrap_servers)
              .option("subscribe", ",".join(topics)).option("startingOffsets", "earliest"))
    if max_offsets_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    return reader.load().select("topic", F.col("value").cast("string").alias("value"), "offset")


def decode(raw: DataFrame) -> DataFrame:
    """JSON payload -> event columns; an unparseable payload becomes
    event_type 'unparseable' with a generated id and the raw text kept.
    Adds ``source`` = 'emqx:<topic>'."""
    parsed = F.from_json(F.col("value"), EVENT_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    p = raw.withColumn("_p", parsed)
    bad = F.col("_p._corrupt").isNotNull() | F.col("_p").isNull()
    fields = [f.name for f in EVENT_SCHEMA.fields if f.name != "_corrupt"]
    cols = []
    for name in fields:
        if name == "event_id":
            cols.append(F.when(bad, F.concat(F.lit("mqtt-"), F.col("offset").cast("string")))
                        .otherwise(F.col("_p.event_id")).alias("event_id"))
        elif name == "event_type":
            cols.append(F.when(bad, F.lit("unparseable")).otherwise(F.col("_p.event_type")).alias("event_type"))
        else:
            cols.append(F.when(bad, F.lit(None)).otherwise(F.col(f"_p.{name}")).alias(name))
    return p.select(*cols, F.when(bad, F.col("value")).alias("raw"),
                    F.concat(F.lit("emqx:"), F.col("topic")).alias("source"), "offset")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def drain(spark: SparkSession, source: DataFrame, checkpoint: str, sink: str) -> DataFrame:
    """Hand over everything received since the last drain, once.

    ``trigger(availableNow=True)`` processes exactly the unseen input and
    the checkpoint remembers it, so the next drain starts after it.  A batch
    that is run again overwrites its own folder."""
    run = f"{sink.rstrip('/')}/run={uuid.uuid4().hex[:12]}"
    q = (source.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{run}/batch-{n}"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if not path_exists(spark, run):  # nothing new arrived
        return spark.createDataFrame([], source.schema)
    return spark.read.schema(source.schema).parquet(f"{run}/batch-*")
