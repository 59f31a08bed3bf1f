"""Geo and time-series KPIs (A15, A16, U6) -- re-aimed from the
reference's fixed dashboard payload to jobs over the event table.
Heat and change formulas are ours (the reference ships constants)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.numeric import MONEY


def region_heat(region_revenue: DataFrame) -> DataFrame:
    """heat = revenue / max revenue; the top region flagged (ties to
    the alphabetically first).  Input is one row per region (aggregated)."""
    w = Window.partitionBy()
    top = F.min_by("region", F.struct(-F.col("revenue"), "region")).over(w)
    mx = F.max("revenue").over(w)
    return region_revenue.select(
        "region", "revenue", F.round(F.when(mx > 0, F.col("revenue") / mx).otherwise(F.lit(0.0)), 3).alias("heat"),
        (F.col("region") == top).alias("is_top"))


def hourly_revenue(events: DataFrame) -> DataFrame:
    """Purchase revenue per hour."""
    p = events.filter(F.col("event_type") == "purchase")
    return (p.groupBy(F.date_trunc("hour", "event_time").alias("hour"))
             .agg(F.sum(F.col("revenue").cast(MONEY)).cast("double").alias("revenue"),
                  F.count(F.lit(1)).alias("purchases")))


def daily_kpis(events: DataFrame) -> DataFrame:
    """Per day revenue, active customers, conversion (purchasers /
    active customers) and the change on the day before."""
    day = F.to_date("event_time")
    per_cust = (events.groupBy(day.alias("day"), "customer_id")
                      .agg(F.max(F.col("event_type") == "purchase").alias("bought"),
                           F.sum(F.when(F.col("event_type") == "purchase", F.col("revenue").cast(MONEY))).alias("rev")))
    d = per_cust.groupBy("day").agg(
        F.coalesce(F.sum("rev"), F.lit(0)).cast("double").alias("revenue"),
        F.count(F.lit(1)).alias("active_customers"),
        F.count_if("bought").alias("purchasers"))
    w = Window.orderBy("day")  # one row per day
    prev = F.lag("revenue").over(w)
    return d.select(
        "day", "revenue", "active_customers", "purchasers",
        F.round(F.col("purchasers") / F.col("active_customers"), 4).alias("conversion"),
        F.round(F.col("revenue") - prev, 2).alias("revenue_change"),
        F.round(F.when(prev > 0, (F.col("revenue") - prev) / prev * 100), 1).alias("revenue_change_pct"))


def history_with_forecast(series: DataFrame, forecast: DataFrame) -> DataFrame:
    """The actual points in order, then one 'Next' row with the
    prediction."""
    actual = series.select("series_id", F.col("t").alias("ordinal"), F.col("day").cast("string").alias("label"),
                           F.col("value"), F.lit("actual").alias("kind"))
    nxt = forecast.select("series_id", (F.col("points") + 1).alias("ordinal"), F.lit("Next").alias("label"),
                          F.col("prediction").alias("value"), F.lit("forecast").alias("kind"))
    return actual.unionByName(nxt)
