"""Series forecasts for every series at once.

A series is a long table (series_id, t, value).  Per-series statistics are
grouped aggregates; "last n points" is a row_number filter, which Spark
turns into a WindowGroupLimit (partial top-n before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.numeric import MONEY, clamp


def daily_quantity(orders: DataFrame, as_of_day=None) -> DataFrame:
    """A10: units per (product, UTC day).  Missing quantity counts 1; a
    missing timestamp falls on ``as_of_day``."""
    day = F.to_date(F.coalesce("created_at", "event_time") if "event_time" in orders.columns else F.col("created_at"))
    if as_of_day is not None:
        day = F.coalesce(day, F.lit(as_of_day).cast("date"))
    return (orders.filter(F.col("product_id").isNotNull())
                  .groupBy("product_id", day.alias("day"))
                  .agg(F.sum(F.coalesce(F.col("quantity"), F.lit(1))).cast("bigint").alias("quantity")))


def demand_forecast(daily: DataFrame, periods: int = 7, window: int = 7) -> DataFrame:
    """M3: mean and mean step of the last ``window`` sale days (no zero
    filling, trap T12); day h predicts max(0, avg + trend*h)."""
    d = daily.withColumn("q", F.greatest(F.col("quantity"), F.lit(0)))
    w = Window.partitionBy("product_id").orderBy(F.desc("day"))
    hist = d.groupBy("product_id").agg(F.count(F.lit(1)).alias("history_points"))
    last = d.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= window)
    stats = last.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("q").alias("daily_average"),
        F.max_by("q", "day").alias("newest"),
        F.min_by("q", "day").alias("oldest"))
    trend = F.when(F.col("n") > 1, (F.col("newest") - F.col("oldest")) / (F.col("n") - 1)).otherwise(F.lit(0.0))
    s = stats.join(hist, "product_id").withColumn("trend", trend)
    out = s.select("product_id", "history_points", "daily_average", "trend",
                   F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("period"))
    return out.select(
        "product_id", "history_points",
        F.round("daily_average", 2).alias("daily_average_units"),
        F.round("trend", 2).alias("trend_units"),
        F.col("period").cast("int").alias("period"),
        F.round(F.greatest(F.lit(0.0), F.col("daily_average") + F.col("trend") * F.col("period")), 2).alias("predicted_units"),
    )


def revenue_series(orders: DataFrame, key: str = "customer_id", min_points: int = 3) -> DataFrame:
    """Daily revenue of all of each ``key``'s order days,
    numbered 1..n oldest first; series shorter than ``min_points`` dropped."""
    daily = (orders.groupBy(F.col(key).alias("series_id"), F.to_date("created_at").alias("day"))
                   .agg(F.sum(F.col("revenue").cast(MONEY)).cast("double").alias("value")))
    series = Window.partitionBy("series_id")
    sized = daily.withColumn("t", F.row_number().over(series.orderBy("day"))).withColumn("n", F.count(F.lit(1)).over(series))
    return sized.filter(F.col("n") >= min_points).select("series_id", "day", F.col("t").cast("bigint").alias("t"), "value")


def revenue_forecast(series: DataFrame) -> DataFrame:
    """M4: next = max(0, last + mean delta); confidence clamp(1 - |trend| /
    max(mean, 1), .55, .93)."""
    s = series.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("points"),
        (F.sum(F.col("value").cast(MONEY)).cast("double") / F.count(F.lit(1))).alias("mean"),
        F.max_by("value", "t").alias("last"), F.min_by("value", "t").alias("first"))
    trend = F.when(F.col("points") > 1, (F.col("last") - F.col("first")) / (F.col("points") - 1)).otherwise(F.lit(0.0))
    s = s.withColumn("trend", trend)
    conf = clamp(1 - F.abs("trend") / F.greatest(F.col("mean"), F.lit(1.0)), 0.55, 0.93)
    return s.select("series_id", "points",
                    F.round(F.greatest(F.lit(0.0), F.col("last") + F.col("trend")), 2).alias("prediction"),
                    F.round(conf, 3).alias("confidence"))


def weighted_revenue_forecast(series: DataFrame) -> DataFrame:
    """M5: position-weighted mean (W3) plus .35 of the last step."""
    n = Window.partitionBy("series_id")
    marked = series.withColumn("_n", F.max("t").over(n))
    s = marked.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("points"),
        (F.sum(F.col("value").cast(MONEY) * F.col("t")).cast("double") / F.sum("t")).alias("wavg"),
        F.max(F.when(F.col("t") == F.col("_n"), F.col("value"))).alias("last"),
        F.max(F.when(F.col("t") == F.col("_n") - 1, F.col("value"))).alias("prev"))
    delta = F.col("last") - F.col("prev")
    conf = clamp(1 - F.abs(delta) / F.greatest(F.col("wavg"), F.lit(1.0)), 0.58, 0.91)
    return s.select("series_id", "points",
                    F.round(F.greatest(F.lit(0.0), F.col("wavg") + delta * 0.35), 2).alias("prediction"),
                    F.round(conf, 3).alias("confidence"))


# fixed value: z for an 80 % central interval
Z80 = 1.2816


def resample(history: DataFrame, frequency: str = "D") -> DataFrame:
    """(series_id, ds, value): totals per day (D), week to Sunday (W) or month (M),
    each at its last day.  ``history`` is (series_id, day, value)."""
    ends = {"D": F.col("day"), "W": F.next_day(F.date_sub("day", 1), "SU"), "M": F.last_day("day")}
    return (history.filter(F.col("value").isNotNull() & F.col("day").isNotNull()).groupBy("series_id", ends[frequency].alias("ds"))
                   .agg(F.sum(F.col("value").cast(MONEY)).alias("value")))


def _step(ds: Column, frequency: str) -> Column:
    """Number of the period that ends at ``ds``, counted from a fixed day."""
    if frequency == "M":
        return (F.year(ds) * 12 + F.month(ds)).cast("bigint")
    days = F.datediff(ds, F.lit("1970-01-04").cast("date")).cast("bigint")  # a Sunday
    return F.floor(days / 7).cast("bigint") if frequency == "W" else days


def _later(ds: Column, periods: int, frequency: str) -> Column:
    """The next ``periods`` period ends."""
    if frequency == "M":
        return F.transform(F.sequence(F.lit(1), F.lit(periods)), lambda h: F.last_day(F.add_months(ds, h)))
    days = 7 if frequency == "W" else 1
    return F.transform(F.sequence(F.lit(1), F.lit(periods)), lambda h: F.date_add(ds, h * days))


def seasonal_forecast(history: DataFrame, periods: int = 7, frequency: str = "D") -> DataFrame:
    """M6 (re-aimed): trend and weekday levels by least squares, 80 % band.

    The model has one level per season (weekday for daily points, one season for
    weeks and months) and one slope.  Its normal equations need a season's sums
    n, x, y, xx, xy, yy alone: the slope is the sum over seasons of the centred
    xy by that of the centred xx, a level is mean y - slope * mean x.  Sums are
    exact decimals of whole cents and period numbers.  Where no season has two
    points, all points are one season.  A season that was never seen has the
    mean level.  Sigma is the root of the squared residuals' sum by the degrees
    of freedom left (0 without any).  Series with < 3 points are dropped.
    """
    season = F.dayofweek("ds") if frequency == "D" else F.lit(1)
    exact = lambda c: c.cast("decimal(38,0)")
    points = resample(history, frequency).select(
        "series_id", "ds", season.alias("season"), exact(_step(F.col("ds"), frequency)).alias("x"), exact(F.col("value") * 100).alias("y"))
    wide = {"n": F.lit(1), "x": F.col("x"), "y": F.col("y"), "xx": exact(F.col("x") * F.col("x")), "xy": exact(F.col("x") * F.col("y")), "yy": exact(F.col("y") * F.col("y"))}
    sums = points.groupBy("series_id", "season").agg(F.max("ds").alias("d1"), *(exact(F.sum(c)).alias(name) for name, c in wide.items()))

    def centred(a: str, b: str, ab: str) -> Column:
        """n times the centred sum of a and b."""
        return (exact(F.col("n") * F.col(ab)) - exact(F.col(a) * F.col(b))).cast("double")

    parts = {"sxx": ("x", "x", "xx"), "sxy": ("x", "y", "xy"), "syy": ("y", "y", "yy")}
    number = F.col("n").cast("double")
    own = sums.select("series_id", "season", "d1", *wide, *((centred(*p) / number).alias(name) for name, p in parts.items()))
    one = own.groupBy("series_id").agg(
        F.max("d1").alias("d1"), F.count(F.lit(1)).alias("seasons"), *(exact(F.sum(c)).alias(c) for c in wide),
        *(F.sum(c).alias(f"_{c}") for c in parts),
        F.sort_array(F.collect_list(F.struct("season", (F.col("y").cast("double") / number).alias("my"), (F.col("x").cast("double") / number).alias("mx"),
                                             number.alias("n")))).alias("levels")).filter(F.col("n") >= 3)  # one per season
    split = F.col("_sxx") > 0
    sxx, sxy, syy = (F.when(split, F.col(f"_{name}")).otherwise(centred(*p) / number) for name, p in parts.items())
    fit = one.select("*", split.alias("split"), F.when(sxx > 0, sxy / sxx).otherwise(F.lit(0.0)).alias("slope"), sxy.alias("sxy"), syy.alias("syy"))
    left = F.col("n").cast("double") - F.when(F.col("split"), F.col("seasons")).otherwise(F.lit(1)) - 1
    rss = F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("sxy"))
    mean = (F.col("y").cast("double") - F.col("slope") * F.col("x").cast("double")) / number
    fit = fit.withColumn("sigma", F.when(left > 0, F.sqrt(rss / left)).otherwise(F.lit(0.0))).withColumn("mean_level", mean)
    steps = fit.select("*", F.explode(_later(F.col("d1"), periods, frequency)).alias("ds"))
    due = season if frequency == "D" else F.lit(1)
    seen = F.element_at(F.map_from_entries(F.transform("levels", lambda s: F.struct(s["season"], s["my"] - F.col("slope") * s["mx"]))), due)
    level = F.when(F.col("split"), F.coalesce(seen, F.col("mean_level"))).otherwise(F.col("mean_level"))
    yhat = (level + F.col("slope") * _step(F.col("ds"), frequency).cast("double")) / 100
    band = Z80 * F.col("sigma") / 100
    return steps.select("series_id", F.col("n").cast("bigint").alias("history_points"), "ds", F.round(yhat, 2).alias("yhat"),
                        F.round(yhat - band, 2).alias("yhat_lower"), F.round(yhat + band, 2).alias("yhat_upper"))
