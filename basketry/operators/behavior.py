"""Customer behaviour.

Order totals, top categories and top products are each a partial+final
aggregate of the order rows by their own key, with the columns they need: a
common (customer, product, category) grain is as large as the order table and
would be shuffled for each of them first.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.numeric import MONEY
from basketry.functions.scoring import behavior_segment
from basketry.functions.timefn import whole_days
from basketry.operators.topk import rank_counted, top_items_array

# Encounter order of a Counter fed by orders newest-first, then views
# newest-first: a flat struct whose ascending order is that encounter order.
# Rows tying on all of its fields are the same product of the same order
# line, so the key is exact for first-seen per product and per category.
SEEN_TYPE = "struct<src:int,t:bigint,id:bigint,line:bigint,pid:bigint>"


def order_seen_key() -> Column:
    return F.struct(F.lit(0).alias("src"), (-F.unix_micros("created_at")).alias("t"),
                    (-F.col("order_id").cast("bigint")).alias("id"), F.col("line").cast("bigint").alias("line"),
                    F.col("product_id").cast("bigint").alias("pid")).cast(SEEN_TYPE)


def view_seen_key() -> Column:
    return F.struct(F.lit(1).alias("src"), (-F.unix_micros("created_at")).alias("t"),
                    (-F.col("event_id").cast("bigint")).alias("id"), F.lit(0).cast("bigint").alias("line"),
                    F.lit(0).cast("bigint").alias("pid")).cast(SEEN_TYPE)


def _present(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c).cast("string") != "")


def sales_grain(sales: DataFrame) -> DataFrame:
    """(customer, product, category) partial totals of the order table."""
    return (sales.groupBy("customer_id", "product_id", "category")
                 .agg(F.count(F.lit(1)).alias("n"),
                      F.sum(F.col("revenue").cast(MONEY)).alias("rev"),
                      F.max(F.coalesce("created_at", "event_time") if "event_time" in sales.columns
                            else F.col("created_at")).alias("last_at"),
                      # the product is the same in all rows of a group
                      F.min(F.struct(*(order_seen_key()[c].alias(c) for c in ("t", "id", "line")))).alias("seen"))
                 .withColumn("seen", F.struct(F.lit(0).alias("src"), "seen.t", "seen.id", "seen.line",
                                              F.col("product_id").cast("bigint").alias("pid")).cast(SEEN_TYPE)))


def order_category_counts(sales: DataFrame) -> DataFrame:
    """(customer, category) order counts with first-seen key, straight from
    the order rows (for callers that need no other per-product totals)."""
    return (sales.filter(_present("category")).groupBy("customer_id", "category")
                 .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*(order_seen_key()[c].alias(c) for c in ("t", "id", "line", "pid")))).alias("seen"))
                 .withColumn("seen", F.struct(F.lit(0).alias("src"), "seen.t", "seen.id", "seen.line", "seen.pid").cast(SEEN_TYPE)))


def order_product_counts(sales: DataFrame) -> DataFrame:
    """(customer, product) order counts with first-seen key, straight from the order rows."""
    return (sales.filter(_present("product_id")).groupBy("customer_id", "product_id")
                 .agg(F.count(F.lit(1)).alias("n"),
                      # the product is the same in all rows of a group
                      F.min(F.struct(*(order_seen_key()[c].alias(c) for c in ("t", "id", "line")))).alias("seen"))
                 .withColumn("seen", F.struct(F.lit(0).alias("src"), "seen.t", "seen.id", "seen.line",
                                              F.col("product_id").cast("bigint").alias("pid")).cast(SEEN_TYPE)))


def ranked_categories(grain: DataFrame, views: DataFrame, k: int = 3) -> DataFrame:
    """Top-k categories over orders + views (U1 then A9).  ``grain`` is the
    order grain (or ``order_category_counts``)."""
    o = grain.filter(_present("category")).select("customer_id", "category", "n", "seen")
    v = (views.filter(_present("category")).groupBy("customer_id", "category")
              .agg(F.count(F.lit(1)).alias("n"), F.min(view_seen_key()).alias("seen")))
    both = (o.unionByName(v).groupBy("customer_id", "category")
             .agg(F.sum("n").alias("n"), F.min("seen").alias("seen")))
    return rank_counted(both, ["customer_id"], "category", "n", "seen", k)


def ranked_products(sales: DataFrame, k: int = 3) -> DataFrame:
    return rank_counted(order_product_counts(sales), ["customer_id"], "product_id", "n", "seen", k)


def customer_behavior(sales: DataFrame, views: DataFrame, as_of: dt.datetime, k: int = 3) -> DataFrame:
    """A4 for every customer that has orders or views (J3 full outer)."""
    ts = F.coalesce("created_at", "event_time") if "event_time" in sales.columns else F.col("created_at")
    o = sales.groupBy("customer_id").agg(F.count(F.lit(1)).alias("orders"), F.sum(F.col("revenue").cast(MONEY)).alias("rev"), F.max(ts).alias("last_at"))
    v = views.groupBy("customer_id").agg(F.count(F.lit(1)).alias("browse_events"))
    cats = top_items_array(ranked_categories(order_category_counts(sales), views, k), ["customer_id"], "preferred_categories")
    prods = top_items_array(ranked_products(sales, k), ["customer_id"], "top_products")
    as_of_col = F.lit(as_of).cast("timestamp")
    recency = F.when(F.col("last_at").isNull(), F.lit(90)).otherwise(
        F.greatest(F.lit(0), whole_days(F.col("last_at"), as_of_col))).cast("bigint")
    j = (o.join(v, "customer_id", "full_outer")
          .join(cats, "customer_id", "left")
          .join(prods, "customer_id", "left"))
    orders = F.coalesce("orders", F.lit(0)).cast("bigint")
    return j.select(
        "customer_id",
        orders.alias("orders"),
        F.coalesce("browse_events", F.lit(0)).cast("bigint").alias("browse_events"),
        orders.alias("purchase_frequency"),
        F.coalesce(F.col("rev"), F.lit(0)).cast("double").alias("monetary_value"),
        recency.alias("recency_days"),
        F.coalesce("preferred_categories", F.array().cast("array<struct<name:string,count:bigint>>")).alias("preferred_categories"),
        F.coalesce("top_products", F.array().cast("array<struct<name:bigint,count:bigint>>")).alias("top_products"),
        behavior_segment(orders, recency, F.col("preferred_categories")[0]["name"]).alias("behavior_segment"),
    )


def latest_activity(sales: DataFrame) -> DataFrame:
    """Newest of coalesce(created_at, event_time) per customer."""
    ts = F.coalesce("created_at", "event_time") if "event_time" in sales.columns else F.col("created_at")
    return sales.groupBy("customer_id").agg(F.max(ts).alias("last_activity"))


def order_feature_record(sales: DataFrame, as_of: dt.datetime) -> DataFrame:
    """A5: the order-side feature document of every ordering customer.

    preferred_category is the mode; ties go to the category met first in
    insertion (oldest-first) order.
    """
    per_cat = (sales.filter(F.col("category").isNotNull() & (F.col("category") != ""))
                    .groupBy("customer_id", "category")
                    .agg(F.count(F.lit(1)).alias("n"),
                         F.min(F.struct((F.unix_micros("created_at")).alias("t"), F.col("order_id").alias("id"),
                                        F.col("line").alias("line"), F.col("product_id").alias("pid"),
                                        F.col("quantity").alias("qty"), F.col("revenue").alias("rev"))).alias("first")))
    mode = (per_cat.groupBy("customer_id")
                   .agg(F.min(F.struct((-F.col("n")).alias("neg_n"), F.col("first").alias("first"),
                                       F.col("category").alias("category"))).alias("m"))
                   .select("customer_id", F.col("m.category").alias("preferred_category")))
    tot = sales.groupBy("customer_id").agg(F.count(F.lit(1)).alias("frequency"),
                                           F.sum(F.col("revenue").cast(MONEY)).alias("rev"),
                                           F.max("created_at").alias("last_at"))
    as_of_col = F.lit(as_of).cast("timestamp")
    return tot.join(mode, "customer_id", "left").select(
        "customer_id",
        F.greatest(F.lit(0), whole_days(F.col("last_at"), as_of_col)).cast("bigint").alias("recency_days"),
        F.col("frequency").cast("bigint").alias("frequency"),
        F.col("rev").cast("double").alias("monetary_value"),
        F.coalesce("preferred_category", F.lit("unknown")).alias("preferred_category"),
        F.least(F.col("frequency") / 12, F.lit(1.0)).alias("engagement_depth"),
    )


def behavior_feature_record(behavior: DataFrame) -> DataFrame:
    """The behaviour-side feature document."""
    return behavior.select(
        "customer_id", "recency_days",
        F.col("purchase_frequency").alias("frequency"),
        "monetary_value",
        F.least((F.col("browse_events") + F.col("orders")) / 12, F.lit(1.0)).alias("engagement_depth"),
    )
