"""Scans with optional equality filters, newest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Total orders: created_at alone repeats (day resolution), so every scan
# carries enough tie-breaks to be deterministic.
def sales_newest_first() -> list[Column]:
    return [F.desc("created_at"), F.desc("order_id"), F.asc("line"), F.asc("product_id"),
            F.asc("quantity"), F.asc("revenue")]


def views_newest_first() -> list[Column]:
    return [F.desc("created_at"), F.desc("event_id")]


def _equals(df: DataFrame, **filters) -> DataFrame:
    for col, value in filters.items():
        if value is not None:
            df = df.filter(F.col(col) == F.lit(value))
    return df


def order_scan(sales: DataFrame, customer_id=None, product_id=None) -> DataFrame:
    """Pushed-down equality filters, newest first."""
    return _equals(sales, customer_id=customer_id, product_id=product_id).orderBy(*sales_newest_first())


def browse_scan(views: DataFrame, customer_id=None) -> DataFrame:
    """S2."""
    return _equals(views, customer_id=customer_id).orderBy(*views_newest_first())


def review_scan(reviews: DataFrame, product_id=None) -> DataFrame:
    """S3."""
    return _equals(reviews, product_id=product_id).orderBy(F.desc("created_at"), F.desc("review_id"))


def catalog_scan(products: DataFrame) -> DataFrame:
    """Active unless explicitly false (missing/null count as active),
    timestamps hidden, by name."""
    keep = products.filter(F.coalesce(F.col("active"), F.lit(True)))
    hidden = [c for c in ("created_at", "updated_at", "_id") if c in products.columns]
    return keep.drop(*hidden).orderBy("name", "id")


def account_scan(users: DataFrame) -> DataFrame:
    """Customer accounts, secret columns hidden, newest first."""
    hidden = [c for c in ("password_hash", "_id") if c in users.columns]
    return users.filter(F.col("role") == "customer").drop(*hidden).orderBy(F.desc("created_at"), "email")


def table_counts(named: dict[str, DataFrame]) -> DataFrame:
    """One row per table with its row count, as one union plan."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
             for name, df in named.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
