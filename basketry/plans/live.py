"""Streaming plans over the event table (S7-S9, S18, ST2, ST4-ST7).

Streams read the event table's own files, a bounded number of them per batch.
Each event passes as the messages that the shop publishes for it (one topic
for all, a second one for purchases), is decoded and de-duplicated again.  All
folders of a run live under the session's shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketry.operators import insights as I
from basketry.operators.cleaning import clean_events
from basketry.operators.insights import normalize_stream
from basketry.sources.tables import TableSet
from basketry.sources.views import Views
from basketry.streaming import counters
from basketry.streaming import insights as SI
from basketry.streaming import manifest
from basketry.streaming import topics as TP

TOPICS = ["ecommerce", "purchase"]


class StreamedEvents(TableSet):
    """The tables of a folder, ``events`` as a stream of its files."""

    def __init__(self, spark: SparkSession, root: str, files_per_batch: int = 8):
        super().__init__(spark, root)
        self.files_per_batch = files_per_batch

    def table(self, name: str) -> DataFrame:
        if name == "events" and name not in self._cache:
            schema = self.spark.read.parquet(self.path(name)).schema
            reader = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", self.files_per_batch)
            # a pattern, since the table may be one file
            self._cache[name] = reader.parquet(f"{self.root}/event[s].parquet")
        return super().table(name)


def delivered(events: DataFrame) -> DataFrame:
    """Events as they come off the topics: purchases twice."""
    decoded = TP.decode(TP.encode(events, TOPICS, only_purchases_for={"purchase"}))
    return decoded.withColumn("event_time", F.to_timestamp("event_time"))


def streaming_insights(spark: SparkSession, root: str) -> str:
    """ST1 and ST4 computed by streaming: messages (S9, S7), decode (S8), one row per
    event (ST5), normalise (P8), counters in state (ST2), sinks under a
    manifest.  Returns the folder of the run."""
    base = TP.fresh_dir(spark, "live-insights")
    messages = delivered(Views(StreamedEvents(spark, root)).stream_events())
    counters.run(normalize_stream(SI.dedupe(messages), F.col("source")), base)
    return base


def direct_insights(spark: SparkSession, root: str) -> str:
    """The same over the events themselves, without messages."""
    base = TP.fresh_dir(spark, "live-insights-direct")
    counters.run(normalize_stream(Views(StreamedEvents(spark, root)).stream_events()), base)
    return base


EVENTS = ("event_id string, event_type string, customer_id string, product_id string, product_name string, category string, quantity int, "
          "raw_revenue double, revenue double, event_time timestamp, source string, seq bigint")
INSIGHTS = "event_id string, event_time timestamp, seq bigint, insight_ordinal int, kind string, title string, detail string, severity string"


def sink(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Table ``events`` or ``insights`` of a run, complete batches only."""
    return manifest.read_complete(spark, base, name, {"events": EVENTS, "insights": INSIGHTS}[name])


def streaming_hourly_revenue(spark: SparkSession, root: str) -> DataFrame:
    """ST6 on the decoded, de-duplicated stream: all windows, open ones too."""
    base = TP.fresh_dir(spark, "live-hourly")
    return SI.run_hourly(delivered(Views(StreamedEvents(spark, root)).stream_events()), base)[0]


def streaming_clean(spark: SparkSession, root: str) -> DataFrame:
    """ST7: the batch cleaning plan applied to a stream of raw events."""
    base = TP.fresh_dir(spark, "live-clean")
    cleaned = clean_events(Views(StreamedEvents(spark, root)).raw_events())
    SI.run_to_table(cleaned, f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(cleaned.schema).parquet(f"{base}/out")


def live_snapshot(norm_events: DataFrame, insights: DataFrame, n: int = 30) -> dict[str, DataFrame]:
    """ST4: the live view over the event and insight sinks (A12 + T2o):
    newest events and insights, top categories, purchase revenue per
    category, purchases per customer and the buffered event count."""
    return {
        "recent_events": I.recent(norm_events, n),
        "recent_insights": I.recent(insights, n),
        "top_categories": I.top_categories(norm_events, 5),
        "revenue_by_category": I.revenue_by_category(norm_events),
        "customer_purchases": I.purchases_per_customer(norm_events),
        "events_seen": I.events_seen(norm_events),
    }


def snapshot_rows(parts: dict[str, DataFrame]) -> DataFrame:
    """``live_snapshot`` as one table: section, position (in ranked sections), key, value."""
    position = F.lit(None).cast("bigint")

    def ranked(df: DataFrame, order: list[str]) -> DataFrame:
        # at most n rows reach this window
        return df.withColumn("position", F.row_number().over(Window.orderBy(*(F.desc(c) for c in order))).cast("bigint"))

    def rows(section: str, df: DataFrame, position, key, value) -> DataFrame:
        return df.select(F.lit(section).alias("section"), position.alias("position"), key.cast("string").alias("key"), value.cast("double").alias("value"))

    out = [rows("events_seen", parts["events_seen"], position, F.lit("all"), F.col("events_seen")),
           rows("top_categories", parts["top_categories"], F.col("rank"), F.col("category"), F.col("events")),
           rows("revenue_by_category", parts["revenue_by_category"], position, F.col("category"), F.col("revenue")),
           rows("customer_purchases", parts["customer_purchases"], position, F.col("customer_id"), F.col("purchases")),
           rows("recent_events", ranked(parts["recent_events"], ["event_time", "seq"]), F.col("position"), F.col("event_id"), F.col("revenue")),
           rows("recent_insights", ranked(parts["recent_insights"], ["event_time", "seq", "insight_ordinal"]), F.col("position"),
                F.concat_ws(":", "event_id", "kind"), F.lit(None))]
    both = out[0]
    for more in out[1:]:
        both = both.unionByName(more)
    return both
