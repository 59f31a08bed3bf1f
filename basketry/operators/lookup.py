"""Lookups against the product table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_product_name(df: DataFrame, products: DataFrame, id_col: str, out_col: str,
                      small_side: bool = False) -> DataFrame:
    """Left lookup of the product name; unknown id -> the id itself,
    null id -> 'Unknown product'.

    ``small_side=True`` marks ``df`` as bounded (e.g. a top-k result) so the
    product table is joined by shuffling only that side's few keys:
    the small side is broadcast instead of the catalog.
    """
    names = products.select(F.col("id").alias("_pid"), F.col("name").alias("_pname"))
    known = F.col(id_col) == F.col("_pid")
    if small_side:
        # the catalog meets the few ids where it lies; what it has of them is as few
        names = F.broadcast(names.join(F.broadcast(df.select(id_col).distinct()), known).select("_pid", "_pname"))
    j = df.join(names, known, "left")
    name = (F.when(F.col(id_col).isNull(), F.lit("Unknown product"))
             .otherwise(F.coalesce(F.col("_pname"), F.col(id_col).cast("string"))))
    return j.withColumn(out_col, name).drop("_pid", "_pname")


def require_product(df: DataFrame, products: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(matched rows joined with the product, rejected rows with unknown ids)."""
    p = products.withColumnRenamed("id", "_pid")
    matched = df.join(p, F.col(id_col) == F.col("_pid"), "inner").drop("_pid")
    rejected = df.join(p.select("_pid"), F.col(id_col) == F.col("_pid"), "left_anti")
    return matched, rejected
