"""Upsert semantics over append-only and stored tables.

A parquet table has no MERGE; the latest state of a key is derived with a
partial+final aggregate (``max_by`` / ``min_by`` on a version column), which
combines map-side and never sorts a whole key group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _value_cols(df: DataFrame, keys: list[str]) -> list[str]:
    return [c for c in df.columns if c not in keys]


def last_write_wins(df: DataFrame, keys: list[str], version: Column | str) -> DataFrame:
    """Newest row per key (version = any orderable, larger = newer)."""
    v = F.col(version) if isinstance(version, str) else version
    cols = _value_cols(df, keys)
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), v).alias("_r"))
    return agg.select(*keys, *[F.col("_r")[c].alias(c) for c in cols])


def insert_once_touch(df: DataFrame, keys: list[str], ts: str = "updated_at") -> DataFrame:
    """The first version's payload is kept; updated_at is the last touch."""
    cols = [c for c in df.columns if c not in keys and c != ts]
    agg = df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.col(ts)).alias("_r"),
                                F.min(ts).alias("created_at_first"), F.max(ts).alias(ts))
    return agg.select(*keys, *[F.col("_r")[c].alias(c) for c in cols], "created_at_first", ts)


def upsert_with_counter(df: DataFrame, keys: list[str], version: Column | str, counter: str) -> DataFrame:
    """Newest attributes plus the number of touches per key."""
    v = F.col(version) if isinstance(version, str) else version
    cols = _value_cols(df, keys)
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), v).alias("_r"), F.count(F.lit(1)).alias(counter))
    return agg.select(*keys, *[F.col("_r")[c].alias(c) for c in cols], F.col(counter).cast("bigint").alias(counter))


def enforce_unique(df: DataFrame, keys: list[str], order: Column | str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected).  Per key the row with the smallest
    ``order`` (unique per row) is accepted, every later one rejected.

    Both come from the same sorted rows, which are shuffled once and spill
    where they are many."""
    o = F.col(order) if isinstance(order, str) else order
    sorted_rows = Window.partitionBy(*keys).orderBy(o.asc_nulls_last())
    # not a row number: a limit on it would give the accepted rows a shuffle of their own
    marked = df.withColumn("_later", F.lag(F.lit(True), 1, False).over(sorted_rows))
    return marked.filter(~F.col("_later")).drop("_later"), marked.filter("_later").drop("_later")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def merge_last_write(stored: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """S11 against a stored table: of stored and new rows the newest per key."""
    return last_write_wins(stored.unionByName(changes.select(*stored.columns)), keys, version).select(*stored.columns)


def merge_insert_once(stored: DataFrame, changes: DataFrame, keys: list[str], created: str, touched: str) -> DataFrame:
    """S12 against a stored table: a stored key keeps its payload and ``created``, a
    new one gets those of its first change; ``touched`` is the last touch."""
    both = stored.unionByName(changes.select(*stored.columns))
    payload = [c for c in stored.columns if c not in (*keys, touched)]
    first = both.groupBy(*keys).agg(F.min_by(F.struct(*payload), F.col(created)).alias("_r"), F.max(touched).alias(touched))
    return first.select(*keys, *[F.col("_r")[c].alias(c) for c in payload], touched).select(*stored.columns)


def merge_counter(stored: DataFrame, changes: DataFrame, keys: list[str], version: str, counter: str) -> DataFrame:
    """S13 against a stored table: the newest attributes, and the counters of stored
    and new rows added up (a change counts ``counter`` touches)."""
    both = stored.unionByName(changes.select(*stored.columns))
    newest = last_write_wins(both.drop(counter), keys, version)
    sums = both.groupBy(*keys).agg(F.sum(counter).alias(counter))
    return newest.join(sums, keys).select(*stored.columns)
