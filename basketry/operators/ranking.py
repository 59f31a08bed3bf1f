"""Row numbers per key when one key may hold most rows.

``row_number() over (partition by key order by ...)`` sorts all rows of a key in
one task, which is right for keys of a bounded number of rows.  The rows of larger
keys are dealt by ranges of (key, order columns), so such a key has as many
ranges as it needs; a row's number is its place within its range plus the key's
rows in earlier ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.session import materialize

#: Rows of a key that one task sorts at most.
GROUP_ROWS = 1_000_000


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str, ranges: int | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds ``out`` = 1, 2, ... per ``keys`` in ascending ``order``; rows equal in
    all of these columns are numbered in any order."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > group_rows)
    large = materialize(sizes.select(*(F.col(k).alias(f"_g{i}") for i, k in enumerate(keys))), "large-keys")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    if large.isEmpty():
        return df.withColumn(out, place)
    same = [df[k].eqNullSafe(large[f"_g{i}"]) for i, k in enumerate(keys)]
    small = df.join(large, same, "left_anti").withColumn(out, place)
    return small.unionByName(_over_ranges(df.join(large, same, "left_semi"), keys, order, out, ranges))


def _over_ranges(df: DataFrame, keys: list[str], order: list[str], out: str, ranges: int | None) -> DataFrame:
    """The ranges are written with the rows, so that counts and places mean the same
    ranges.  Only keys that several ranges share need an offset: a range begins
    with one such key at most, so the offsets are fewer than the ranges and
    are broadcast."""
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(ranges, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.sum("_n").over(earlier)).where("_before is not null")
    offsets = F.broadcast(offsets.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_range").alias("_r"), "_before"))
    place = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order))
    same = [dealt["_range"] == offsets["_r"], *(dealt[k].eqNullSafe(offsets[f"_k{i}"]) for i, k in enumerate(keys))]
    met = dealt.withColumn("_place", place).join(offsets, same, "left")
    return met.select(*df.columns, (F.col("_place") + F.coalesce("_before", F.lit(0))).alias(out))
