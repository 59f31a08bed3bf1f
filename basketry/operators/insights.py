"""Live insight detection as a batch job (P8, ST1, ST3, A12, W4, W5, T2o).

Events count in arrival order (event_time, then seq); counters are
all-time (trap T9).  Each event yields 0-4 insight rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.text import strip_ws
from basketry.operators.running import running_count, time_bucket

# fixed values: insight kinds, titles, severities and thresholds
HIGH_VALUE_REVENUE = 100
MOMENTUM_EVENTS = 3
REPEAT_PURCHASES = 2


def _text_or(c: Column, default: str) -> Column:
    return F.coalesce(c.cast("string"), F.lit(default))


def normalize_stream(events: DataFrame, source: str | Column = "stream") -> DataFrame:
    """Defaults 'unknown', lower-cased type and category, revenue to cents."""
    cols = set(events.columns)

    def col(name):
        return F.col(name) if name in cols else F.lit(None)
    revenue = F.coalesce(col("revenue").cast("string").try_cast("double"), F.lit(0.0))
    quantity = F.coalesce(col("quantity").cast("string").try_cast("int"), F.lit(0))
    cust = strip_ws(_text_or(col("customer_id"), "unknown"))
    src = source if isinstance(source, Column) else F.lit(source)
    out = events.select(
        _text_or(col("event_id"), "unknown").alias("event_id"),
        F.lower(strip_ws(_text_or(col("event_type"), "unknown"))).alias("event_type"),
        F.when(cust == "", F.lit("unknown")).otherwise(cust).alias("customer_id"),
        col("product_id").cast("string").alias("product_id"),
        F.coalesce(F.nullif(col("product_name").cast("string"), F.lit("")),
                   F.nullif(col("product_id").cast("string"), F.lit("")), F.lit("unknown")).alias("product_name"),
        F.lower(strip_ws(_text_or(col("category"), "unknown"))).alias("category"),
        quantity.alias("quantity"),
        revenue.alias("raw_revenue"),
        F.round(revenue, 2).alias("revenue"),
        col("event_time").alias("event_time"),
        src.alias("source"),
        col("seq").cast("bigint").alias("seq"),
    )
    return out


def with_counters(norm: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """W4 + W5: all-time inclusive category count and customer purchase count."""
    order = ["event_time", "seq"]
    b = time_bucket(F.col("event_time"), bucket_seconds)
    c = running_count(norm, ["category"], order, b, "category_count")
    return running_count(c, ["customer_id"], order, b, "customer_purchases", F.col("event_type") == "purchase")


def detect_insights(counted: DataFrame) -> DataFrame:
    """ST1: one row per (event, insight) with kind, title, detail, severity."""
    rev = F.format_string("%.2f", F.col("revenue"))
    cands = F.array(
        F.when(F.col("event_type") == "purchase", F.struct(
            F.lit(0).alias("ord"), F.lit("purchase_detected").alias("kind"), F.lit("Purchase event detected").alias("title"),
            F.concat(F.col("customer_id"), F.lit(" bought "), F.col("product_name"), F.lit(" for $"), rev, F.lit(".")).alias("detail"),
            F.lit("info").alias("severity"))),
        F.when(F.col("revenue") >= HIGH_VALUE_REVENUE, F.struct(
            F.lit(1).alias("ord"), F.lit("high_value_order").alias("kind"), F.lit("High-value order").alias("title"),
            F.concat(F.col("product_name"), F.lit(" generated $"), rev, F.lit(" in one order.")).alias("detail"),
            F.lit("positive").alias("severity"))),
        F.when(F.col("category_count") >= MOMENTUM_EVENTS, F.struct(
            F.lit(2).alias("ord"), F.lit("category_momentum").alias("kind"), F.lit("Category momentum").alias("title"),
            F.concat(F.col("category"), F.lit(" has "), F.col("category_count").cast("string"), F.lit(" recent events.")).alias("detail"),
            F.lit("positive").alias("severity"))),
        F.when(F.col("customer_purchases") >= REPEAT_PURCHASES, F.struct(
            F.lit(3).alias("ord"), F.lit("repeat_buyer").alias("kind"), F.lit("Repeat buyer activity").alias("title"),
            F.concat(F.col("customer_id"), F.lit(" has "), F.col("customer_purchases").cast("string"),
                     F.lit(" recent purchases.")).alias("detail"),
            F.lit("positive").alias("severity"))),
    )
    fired = counted.select("event_id", "event_time", "seq", F.explode(F.filter(cands, lambda x: x.isNotNull())).alias("i"))
    return fired.select("event_id", "event_time", "seq", F.col("i.ord").alias("insight_ordinal"),
                        F.col("i.kind").alias("kind"), F.col("i.title").alias("title"),
                        F.col("i.detail").alias("detail"), F.col("i.severity").alias("severity"))


def replay_totals(counted: DataFrame) -> DataFrame:
    """ST3: events processed and insights created, one pass."""
    n = (F.when(F.col("event_type") == "purchase", 1).otherwise(0)
         + F.when(F.col("revenue") >= HIGH_VALUE_REVENUE, 1).otherwise(0)
         + F.when(F.col("category_count") >= MOMENTUM_EVENTS, 1).otherwise(0)
         + F.when(F.col("customer_purchases") >= REPEAT_PURCHASES, 1).otherwise(0))
    return counted.agg(F.count(F.lit(1)).alias("processed"), F.sum(n).cast("bigint").alias("insights_created"))


def top_categories(norm: DataFrame, k: int = 5) -> DataFrame:
    """K most frequent categories, ties by first arrival."""
    agg = norm.groupBy("category").agg(F.count(F.lit(1)).alias("events"),
                                       F.min(F.struct("event_time", "seq")).alias("_first"))
    return agg.orderBy(F.desc("events"), "_first").limit(k) \
              .withColumn("rank", F.row_number().over(Window.orderBy(F.desc("events"), "_first")).cast("bigint")).drop("_first")


def revenue_by_category(norm: DataFrame) -> DataFrame:
    """Purchase revenue per category (unrounded per-event revenue)."""
    return (norm.filter(F.col("event_type") == "purchase").groupBy("category")
                .agg(F.sum(F.col("raw_revenue").cast("decimal(18,2)")).cast("double").alias("revenue")))


def purchases_per_customer(norm: DataFrame) -> DataFrame:
    """Purchases per customer."""
    return (norm.filter(F.col("event_type") == "purchase").groupBy("customer_id")
                .agg(F.count(F.lit(1)).alias("purchases")))


def events_seen(norm: DataFrame) -> DataFrame:
    """Number of events."""
    return norm.agg(F.count(F.lit(1)).alias("events_seen"))


def recent(df: DataFrame, n: int = 30) -> DataFrame:
    """T2o: newest n rows by arrival."""
    cols = ["event_time", "seq"] + (["insight_ordinal"] if "insight_ordinal" in df.columns else [])
    return df.orderBy(*[F.desc(c) for c in cols]).limit(n)
