"""Jobs with several outputs from one scan, under one manifest.

The order rows are joined and stored once; every output is computed from that
table and written beside the others, and readers see them when all are there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basketry.operators import baskets, commerce, forecasting, graph, reviews
from basketry.operators.lookup import with_product_name
from basketry.plans.snapshot import customer_snapshot
from basketry.session import materialize, shuffles_removed
from basketry.streaming.manifest import read_complete, write_batch


def order_pipeline(orders: DataFrame, catalog: DataFrame, base: str) -> None:
    """For every order line its event, its purchase edge with the order-time
    churn, and its recommendations: tables events, edges and orders."""
    stored = materialize(orders, "orders")
    write_batch(base, 0, {"events": commerce.purchase_events(stored), "edges": graph.purchase_edges(stored),
                          "orders": commerce.order_scoring(stored, catalog)})


def intelligence_snapshot(orders: DataFrame, views: DataFrame, features: Callable[[DataFrame, DataFrame], DataFrame], products: DataFrame,
                          scored_reviews: DataFrame, as_of, base: str, pairs: int = 10, periods: int = 7, newest: int = 20) -> None:
    """Tables customers, baskets (top pairs), demand (forecasts) and reviews (newest).

    Order rows and browse events are stored, and ``features`` makes the customers'
    features from the stored rows, so that no output joins the tables again.  A
    customer's orders are stored side by side (those of a very large one in several
    files), so that tasks add them up before a shuffle, however many tasks there are."""
    with shuffles_removed(orders.sparkSession):
        stored = materialize(orders.hint("rebalance", "customer_id").sortWithinPartitions("customer_id", "order_id"), "orders")
        seen = materialize(views, "views")
        top = baskets.basket_analysis(stored, limit=pairs)
        for side in ("left", "right"):
            top = with_product_name(top, products, side, f"{side}_name", small_side=True)
        demand = with_product_name(forecasting.demand_forecast(forecasting.daily_quantity(stored), periods), products, "product_id", "product")
        recent = with_product_name(reviews.recent_reviews(scored_reviews, newest), products, "product_id", "product", small_side=True)
        customers = customer_snapshot(stored, seen, features(stored, seen), as_of)
        write_batch(base, 0, {"customers": customers, "baskets": top, "demand": demand, "reviews": recent})


def output(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One table of a finished job."""
    schema = spark.read.parquet(f"{base}/{name}/batch_id=0").schema
    return read_complete(spark, base, name, schema)
