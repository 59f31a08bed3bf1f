"""Top-k of a counter per group (A9, T16, T17) and newest-n per key (W9, T2o).

Counting is a partial+final aggregate (map-side combine), so a hot group
never ships its raw rows through the shuffle: only one row per
(group, item) per map task.  Ranking then runs on the aggregated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_items(df: DataFrame, group_cols: list[str], item_col: str, k: int,
              seen_key: Column | None = None) -> DataFrame:
    """The k most frequent non-null items per group.

    Ties resolve to the item seen first, where ``seen_key`` (any orderable
    expression, smaller = earlier) gives the encounter order; this is how a
    Python Counter resolves ``most_common`` ties.  Output: group_cols, rank
    (1-based), item, item_count.
    """
    seen = seen_key if seen_key is not None else F.col(item_col)
    counted = (df.groupBy(*group_cols, item_col)
                 .agg(F.count(F.lit(1)).alias("item_count"), F.min(seen).alias("_first_seen")))
    return rank_counted(counted, group_cols, item_col, "item_count", "_first_seen", k)


def rank_counted(counted: DataFrame, group_cols: list[str], item_col: str, count_col: str,
                 seen_col: str, k: int) -> DataFrame:
    """Rank pre-aggregated (group, item, count, first_seen) rows; keep k.

    Falsy items (null, '') are dropped after ranking, as ``most_common(k)``
    followed by a falsy filter does (trap T17), so fewer than k may remain.
    """
    w = Window.partitionBy(*group_cols).orderBy(F.desc(count_col), F.asc(seen_col))
    falsy = F.col(item_col).isNull() | (F.col(item_col).cast("string") == "")
    return (counted.withColumn("rank", F.row_number().over(w))
                   .filter((F.col("rank") <= k) & ~falsy)
                   .select(*group_cols, "rank", F.col(item_col).alias("item"),
                           F.col(count_col).alias("item_count")))


def top_items_array(ranked: DataFrame, group_cols: list[str], name: str) -> DataFrame:
    """Collapse ranked rows to one array<struct<name,count>> per group (<= k items)."""
    return (ranked.groupBy(*group_cols)
                  .agg(F.sort_array(F.collect_list(F.struct("rank", F.col("item").alias("name"),
                                                            F.col("item_count").alias("count")))).alias("_r"))
                  .select(*group_cols, F.transform("_r", lambda x: F.struct(x["name"].alias("name"),
                                                                             x["count"].alias("count"))).alias(name)))


def newest_per_key(df: DataFrame, key_cols: list[str], order_cols: list[Column], n: int = 1) -> DataFrame:
    """Newest n rows per key by an explicit total order."""
    w = Window.partitionBy(*key_cols).orderBy(*order_cols)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def newest(df: DataFrame, order_cols: list[Column], n: int) -> DataFrame:
    """Most recent n rows overall (TakeOrderedAndProject)."""
    return df.orderBy(*order_cols).limit(n)
