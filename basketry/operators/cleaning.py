"""Event cleaning (P1-P7, P9, A1-A3, S6, T1o).

One ``select`` normalises, one ``filter`` validates; the aggregates are
single-pass ``groupBy`` jobs over the same lazy plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.functions.geo import region_of
from basketry.functions.numeric import money_sum
from basketry.functions.text import clean_text
from basketry.functions.timefn import parse_utc_timestamp

# fixed values: accepted event types
VALID_EVENT_TYPES = ("cart", "click", "purchase", "view")

RAW_EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("product_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("event_time", T.StringType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
])


def events_from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A local batch to a typed table (S6); numbers are coerced to float first
    so an integer price such as -10 is accepted (trap T1)."""
    fixed = []
    for r in rows:
        rec = {f.name: r.get(f.name) for f in RAW_EVENT_SCHEMA.fields}
        for name in ("price", "lat", "lon"):
            if isinstance(rec[name], (int, float)) and not isinstance(rec[name], bool):
                rec[name] = float(rec[name])
        fixed.append(rec)
    return spark.createDataFrame(fixed, RAW_EVENT_SCHEMA)


def normalize_events(raw: DataFrame) -> DataFrame:
    """Normalised columns plus a validity flag."""
    quantity = F.coalesce(F.col("quantity").cast("string").try_cast("int"), F.lit(0))
    price = F.coalesce(F.col("price").cast("string").try_cast("double"), F.lit(0.0))
    lat = F.col("lat").cast("string").try_cast("double")
    lon = F.col("lon").cast("string").try_cast("double")
    norm = raw.select(
        clean_text(F.col("event_id")).alias("event_id"),
        clean_text(F.col("customer_id")).alias("customer_id"),
        clean_text(F.col("product_id")).alias("product_id"),
        clean_text(F.col("event_type")).alias("event_type"),
        parse_utc_timestamp(F.col("event_time")).alias("event_time"),
        quantity.alias("quantity"),
        price.alias("price"),
        lat.alias("lat"),
        lon.alias("lon"),
    )
    valid = ((F.col("event_id") != "") & (F.col("customer_id") != "")
             & F.col("event_type").isin(*VALID_EVENT_TYPES) & F.col("event_time").isNotNull()
             & (F.col("quantity") >= 0) & (F.col("price") >= 0))
    revenue = F.when(F.col("event_type") == "purchase", F.col("quantity") * F.col("price")).otherwise(F.lit(0.0))
    return norm.select(
        "event_id", "customer_id", "product_id", "event_type", "event_time", "quantity",
        F.round("price", 2).alias("price"),
        F.round(revenue, 2).alias("revenue"),
        "lat", "lon",
        region_of(F.col("lat"), F.col("lon")).alias("region"),
        valid.alias("is_valid"),
    )


def clean_events(raw: DataFrame) -> DataFrame:
    """Cleaned records (unordered; order with ``order_cleaned``)."""
    return normalize_events(raw).filter("is_valid").drop("is_valid")


def order_cleaned(clean: DataFrame) -> DataFrame:
    """T1o: by time, ties broken by event_id then the remaining columns."""
    return clean.orderBy("event_time", "event_id", "customer_id", "product_id", "quantity", "price")


def event_type_counts(clean: DataFrame) -> DataFrame:
    """A1."""
    return clean.groupBy("event_type").agg(F.count(F.lit(1)).alias("event_count"))


def region_revenue(clean: DataFrame) -> DataFrame:
    """A2: per-row cent amounts summed exactly (trap T5)."""
    return clean.groupBy("region").agg(
        F.count(F.lit(1)).alias("event_count"),
        money_sum(F.col("revenue")).alias("revenue"))


def clean_totals(raw: DataFrame) -> DataFrame:
    """A3: input / clean / dropped counts in one pass."""
    n = normalize_events(raw)
    return n.agg(F.count(F.lit(1)).alias("input_count"),
                 F.count_if(F.col("is_valid")).alias("clean_count")) \
            .withColumn("dropped_count", F.col("input_count") - F.col("clean_count"))


# ---- row validation (P9) ----------------------------------------------------
# fixed values: quantity 1-10, dwell 0-3600 s, rating 1-5, review text 3-1000
# characters, customer_id 3-80 characters
def _check(cond, reason):
    return F.when(~F.coalesce(cond, F.lit(False)), F.lit(reason))


def validate_orders(requests: DataFrame) -> DataFrame:
    """Order requests with a reason array; empty array = valid."""
    cid_len = F.length(F.col("customer_id").cast("string"))
    reasons = F.array_compact(F.array(
        _check((cid_len >= 3) & (cid_len <= 80), "customer_id_length"),
        _check(F.col("product_id").isNotNull(), "product_id_missing"),
        _check((F.col("quantity") >= 1) & (F.col("quantity") <= 10), "quantity_range"),
    ))
    return requests.withColumn("reasons", reasons).withColumn("is_valid", F.size("reasons") == 0)


def validate_browse(requests: DataFrame) -> DataFrame:
    cid_len = F.length(F.col("customer_id").cast("string"))
    reasons = F.array_compact(F.array(
        _check((cid_len >= 3) & (cid_len <= 80), "customer_id_length"),
        _check((F.col("dwell_seconds") >= 0) & (F.col("dwell_seconds") <= 3600), "dwell_range"),
    ))
    return requests.withColumn("reasons", reasons).withColumn("is_valid", F.size("reasons") == 0)


def validate_reviews(requests: DataFrame) -> DataFrame:
    cid_len = F.length(F.col("customer_id").cast("string"))
    text_len = F.length("text")
    reasons = F.array_compact(F.array(
        _check((cid_len >= 3) & (cid_len <= 80), "customer_id_length"),
        _check((F.col("rating") >= 1) & (F.col("rating") <= 5), "rating_range"),
        _check((text_len >= 3) & (text_len <= 1000), "text_length"),
    ))
    return requests.withColumn("reasons", reasons).withColumn("is_valid", F.size("reasons") == 0)
