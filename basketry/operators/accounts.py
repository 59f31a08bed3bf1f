"""Customer accounts and their recent-order profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.scoring import account_segment
from basketry.functions.text import account_label, customer_id_from_email
from basketry.operators.commerce import category_recommendations, without_bought


def order_profile(orders: DataFrame, recent: int = 12, categories: int = 4, history: int = 6) -> DataFrame:
    """Of each customer's newest ``recent`` orders: distinct categories by
    recency (first ``categories``), positive revenues of the newest
    ``history`` in time order, the count, the M18 segment, and category and
    product of the newest one.  A missing revenue is the order's ``total``, if
    there is such a column, else 0.

    The per-customer limit is a rank filter, planned as WindowGroupLimit:
    every map task keeps only its newest ``recent`` rows per customer before
    the shuffle, so a hot customer cannot flood one task.
    """
    order = [F.desc("created_at"), F.desc("order_id"), F.asc("line"), F.asc("product_id"),
             F.asc("quantity"), F.asc("revenue")]
    w = Window.partitionBy("customer_id").orderBy(*order)
    top = orders.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= recent)
    cat = F.coalesce(F.col("category"), F.col("product.category")) if "product" in orders.columns else F.col("category")
    known = [F.col(c).cast("double") for c in ("revenue", "total") if c in orders.columns]
    rev = F.coalesce(*known, F.lit(0.0))
    prof = top.groupBy("customer_id").agg(
        F.sort_array(F.collect_list(F.struct("rn", cat.alias("category"), rev.alias("revenue"), "product_id"))).alias("_o"),
        F.count(F.lit(1)).alias("recent_order_count"))
    cats = F.array_distinct(F.filter(F.transform("_o", lambda o: o["category"]), lambda c: c.isNotNull() & (c != "")))
    hist = F.reverse(F.filter(F.slice("_o", 1, history), lambda o: o["revenue"] > 0))
    return prof.select(
        "customer_id",
        F.slice(cats, 1, categories).alias("recent_categories"),
        F.transform(hist, lambda o: F.round(o["revenue"], 2)).alias("revenue_history"),
        F.col("recent_order_count").cast("bigint").alias("recent_order_count"),
        account_segment(F.col("recent_order_count"), cats).alias("segment"),
        F.col("_o")[0]["category"].alias("latest_category"), F.col("_o")[0]["product_id"].alias("latest_product"))


def account_profiles(users: DataFrame, orders: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every customer account with its order profile and the recommendations of
    its newest order; accounts without orders get the default profile."""
    cid = F.coalesce(F.col("customer_id").cast("string"), customer_id_from_email(F.col("email"))) \
        if "customer_id" in users.columns else customer_id_from_email(F.col("email"))
    accts = users.filter(F.col("role") == "customer").select(
        cid.alias("id"), account_label(F.col("email")).alias("label"), "email",
        customer_id_from_email(F.col("email")).alias("email_customer_id"))
    per_cat = category_recommendations(orders, catalog)
    prof = order_profile(orders).withColumn("id", F.col("customer_id").cast("string")).drop("customer_id")
    prof = prof.join(per_cat, F.col("latest_category").eqNullSafe(F.col("input_key")), "left")
    latest = without_bought(F.coalesce("recs", F.array().cast(per_cat.schema["recs"].dataType)), F.col("latest_product"))
    j = accts.join(prof.withColumn("latest", latest), "id", "left")
    return j.select(
        "id", "label", "email", "email_customer_id",
        F.coalesce("segment", F.lit("Registered customer")).alias("segment"),
        F.coalesce("recent_categories", F.array().cast("array<string>")).alias("recent_categories"),
        F.coalesce("revenue_history", F.array().cast("array<double>")).alias("revenue_history"),
        F.coalesce("recent_order_count", F.lit(0).cast("bigint")).alias("recent_order_count"),
        F.coalesce(F.transform("latest", lambda p: p.cast("string")), F.array().cast("array<string>")).alias("latest_recommendations"))
