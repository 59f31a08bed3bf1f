"""Running (cumulative) counts that scale with skewed keys.

``count(*) over (partition by key order by t)`` puts every row of a key in
one task; with six categories, or one customer holding a third of the
events, that is one huge sort.  Instead the inclusive running count is
split in levels:

1. totals per (key, bucket, second): a partial+final aggregate;
2. a prefix sum over a bucket's seconds, and one over a key's buckets
   (windows over aggregated rows: a bucket's length in seconds at most, and
   one row per bucket);
3. the rank among the key's rows of one second.

count = earlier buckets + earlier seconds of the bucket + rank.  Even if all
events share one key and hour, no task holds more than a second of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_count(df: DataFrame, keys: list[str], order_cols: list[str], bucket: Column,
                  out: str, flag: Column | None = None, start: DataFrame | None = None) -> DataFrame:
    """Adds ``out`` = number of rows (or of rows where ``flag``) with the same
    keys up to and including this row, in ``order_cols`` order.  The first
    order column is a timestamp and ``bucket`` must be monotone in it.
    ``start`` (keys, start), one row a key, says what to count on from."""
    val = F.when(flag, F.lit(1)).otherwise(F.lit(0)) if flag is not None else F.lit(1)
    staged = df.withColumn("_b", bucket).withColumn("_s", F.unix_seconds(order_cols[0])).withColumn("_v", val)
    seconds = staged.groupBy(*keys, "_b", "_s").agg(F.sum("_v").alias("_n"))
    before = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    earlier = seconds.withColumn("_seconds", before("_n", Window.partitionBy(*keys, "_b").orderBy("_s")))
    totals = seconds.groupBy(*keys, "_b").agg(F.sum("_n").alias("_n"))
    buckets = totals.withColumn("_buckets", before("_n", Window.partitionBy(*keys).orderBy("_b")))
    same = lambda a, b, on: [a[c].eqNullSafe(b[c]) for c in on]
    if start is not None:
        buckets = buckets.join(start, same(buckets, start, keys), "left").select(
            *(buckets[c] for c in [*keys, "_b"]), (F.col("_buckets") + F.coalesce(start["start"], F.lit(0))).alias("_buckets"))
    base = earlier.join(buckets, same(earlier, buckets, [*keys, "_b"])).select(
        *(earlier[c] for c in [*keys, "_b", "_s"]), (F.col("_seconds") + F.col("_buckets")).alias("_base"))
    inner = Window.partitionBy(*keys, "_b", "_s").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    ranked = staged.withColumn("_in", F.sum("_v").over(inner))
    return (ranked.join(base, same(ranked, base, [*keys, "_b", "_s"])).select(
        *(ranked[c] for c in df.columns), (F.col("_base") + F.col("_in")).cast("bigint").alias(out)))


def time_bucket(ts: Column, seconds: int = 3600) -> Column:
    return F.floor(F.unix_seconds(ts) / seconds)
