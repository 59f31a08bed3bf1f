"""Shop-side jobs over order requests and orders (P9, P12, P13, P19, J2,
J9, M20, S10, S12, S14).

A purchase's recommendations depend on the product category alone, so they are
ranked once per category and joined back to the orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.operators.graph import order_time_churn
from basketry.operators.lookup import require_product
from basketry.operators.recommend import recommend

# fixed values: segment text used when an order is placed
WELLNESS_SEGMENT = "High-LTV wellness buyer"
DEFAULT_SEGMENT = "Active shopper"


def order_events(requests: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P12 + J2: (order events, rejected requests with unknown products).
    revenue = round(price * quantity, 2)."""
    matched, rejected = require_product(requests, products.select("id", "name", "category", "price"), "product_id")
    events = matched.select(
        "request_id", F.lit("purchase").alias("event_type"), "customer_id", "product_id",
        F.col("name").alias("product_name"), "category", "quantity", "price",
        F.round(F.col("price") * F.col("quantity"), 2).alias("revenue"), "event_time")
    return events, rejected


def browse_events(requests: DataFrame, products: DataFrame) -> DataFrame:
    """View requests with null-safe product name and category."""
    p = products.select(F.col("id").alias("_pid"), F.col("name").alias("_name"), F.col("category").alias("_cat"))
    j = requests.join(p, F.col("product_id") == F.col("_pid"), "left")
    return j.select("request_id", F.lit("product_view").alias("event_type"), "customer_id", "product_id",
                    F.col("_name").alias("product_name"), F.col("_cat").alias("category"),
                    F.coalesce(F.col("dwell_seconds"), F.lit(8)).alias("dwell_seconds"), "event_time")


def repair_orders(orders: DataFrame) -> DataFrame:
    """Revenue <- total <- 0; price <- product.price <- 0."""
    return orders.withColumn("revenue", F.coalesce(F.col("revenue"), F.col("total"), F.lit(0.0))) \
                 .withColumn("price", F.coalesce(F.col("price"), F.col("product.price"), F.lit(0.0)))


def category_recommendations(orders: DataFrame, catalog: DataFrame, k: int = 3) -> DataFrame:
    """(input_key, recs): per category of ``orders`` the k products recommended with
    a purchase in it, best first."""
    cust = orders.select(F.col("category").alias("input_key")).distinct().select(
        "input_key", F.when(F.col("input_key") == "wellness", F.lit(WELLNESS_SEGMENT)).otherwise(F.lit(DEFAULT_SEGMENT)).alias("segment"),
        F.array(F.col("input_key")).alias("recent_categories"))
    recs = recommend(cust, catalog, k=k, key="input_key")
    return recs.groupBy("input_key").agg(F.sort_array(F.collect_list(F.struct("rank", "product_id", "score"))).alias("recs"))


def without_bought(recs: Column, bought: Column) -> Column:
    """Product ids of ``recs`` but the bought one, after top-k."""
    return F.transform(F.filter(recs, lambda r: ~r["product_id"].eqNullSafe(bought)), lambda r: r["product_id"])


def order_scoring(orders: DataFrame, catalog: DataFrame, k: int = 3) -> DataFrame:
    """Per order line, recommendations for its category with the bought
    product removed after top-k (J9, T15), and the order-time churn."""
    seg = F.when(F.col("category") == "wellness", F.lit(WELLNESS_SEGMENT)).otherwise(F.lit(DEFAULT_SEGMENT))
    per_cat = category_recommendations(orders, catalog, k)
    o = orders.select("order_id", "line", "customer_id", "product_id", "category", "revenue", seg.alias("segment"))
    j = o.join(per_cat, F.col("category").eqNullSafe(F.col("input_key")), "left")
    recs = F.coalesce(F.col("recs"), F.array().cast(per_cat.schema["recs"].dataType))
    return j.select(
        "order_id", "line", "customer_id", "product_id", "category", "segment",
        without_bought(recs, F.col("product_id")).alias("recommended"),
        F.round(order_time_churn(F.col("revenue").cast("double")) * 100, 1).alias("churn_percent"))


def purchase_events(orders: DataFrame) -> DataFrame:
    """P12 from stored order lines: the event that a placed order publishes."""
    return orders.select(
        F.concat(F.lit("evt-"), F.col("order_id").cast("string"), F.lit("-"), F.col("line").cast("string"), F.lit("-"), F.col("product_id").cast("string")).alias("event_id"),
        F.lit("purchase").alias("event_type"), "order_id", "customer_id", "product_id", "product_name", "category", "quantity", "price",
        F.round(F.col("price") * F.col("quantity"), 2).alias("revenue"), F.col("created_at").alias("event_time"))


def store_orders(order_rows: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Append the order rows and their event projection to two tables
    (one scan: the frame is written once, the event table is projected
    from the written orders) and read both back."""
    order_rows.write.mode("append").parquet(f"{path}/orders")
    stored = order_rows.sparkSession.read.parquet(f"{path}/orders")
    stored.select("order_id", "line", "customer_id", "product_id", "event_type", "revenue", "created_at") \
          .write.mode("append").parquet(f"{path}/events")
    return stored, order_rows.sparkSession.read.parquet(f"{path}/events")


def first_listing(versions: DataFrame, key: str = "id", ts: str = "updated_at") -> DataFrame:
    """The first version's payload per key, touched at the last time."""
    cols = [c for c in versions.columns if c not in (key, ts)]
    agg = versions.groupBy(key).agg(F.min_by(F.struct(*cols), F.col(ts)).alias("_r"),
                                    F.min(ts).alias("created_at"), F.max(ts).alias("updated_at"))
    return agg.select(key, *[F.col("_r")[c].alias(c) for c in cols], "created_at", "updated_at")

