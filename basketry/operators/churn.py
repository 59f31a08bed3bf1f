"""Churn scoring and rule segments over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.scoring import (churn_action, churn_band, churn_components, churn_probability,
                                        rfm_segment)

DRIVER_NAMES = ("recency_days", "frequency", "monetary_value", "discount_sensitivity", "engagement_depth")


def _col_or_null(df: DataFrame, name: str):
    return F.col(name) if name in df.columns else F.lit(None).cast("double")


def churn_scores(features: DataFrame, key: str = "customer_id", keep: list[str] | None = None) -> DataFrame:
    """M1 applied to every row of a feature table.

    Missing inputs take the reference defaults; engagement falls back to
    bundle_affinity, then .5.  ``keep`` carries input columns through (no
    join back onto the inputs).
    """
    engagement = F.coalesce(_col_or_null(features, "engagement_depth"), _col_or_null(features, "bundle_affinity"))
    comps = churn_components(_col_or_null(features, "recency_days"), _col_or_null(features, "frequency"),
                             _col_or_null(features, "monetary_value"), _col_or_null(features, "discount_sensitivity"),
                             engagement)
    prob = churn_probability(comps)
    band = churn_band(prob)
    drivers = F.array(*[F.struct(F.lit(n).alias("feature"), F.round(comps[n], 3).alias("contribution"))
                        for n in DRIVER_NAMES])
    return features.select(
        key, *(keep or []),
        prob.alias("probability"),
        F.round(prob * 100, 1).alias("percent"),
        band.alias("risk_band"),
        churn_action(band).alias("recommended_action"),
        drivers.alias("drivers"),
    )


def flatten_drivers(scores: DataFrame) -> DataFrame:
    """drivers array -> one column per feature (c_<feature>)."""
    cols = [F.col("drivers")[i]["contribution"].alias(f"c_{n}") for i, n in enumerate(DRIVER_NAMES)]
    return scores.select(*[c for c in scores.columns if c != "drivers"], *cols)


def customer_churn(behavior: DataFrame, features: DataFrame) -> DataFrame:
    """M2: behaviour left-joined with stored features.

    Stored values fill in only where behaviour has a zero (trap T21);
    engagement is always (views + orders) / 12 capped at 1.
    """
    f = features.select("customer_id",
                        F.col("frequency").alias("f_frequency"),
                        F.col("monetary_value").alias("f_monetary"),
                        F.col("discount_sensitivity").alias("f_discount"))
    j = behavior.join(f, "customer_id", "left")
    inputs = j.select(
        "customer_id",
        F.col("recency_days").cast("double").alias("recency_days"),
        F.coalesce(F.nullif(F.col("purchase_frequency").cast("double"), F.lit(0.0)),
                   F.col("f_frequency").cast("double"), F.lit(1.0)).alias("frequency"),
        F.coalesce(F.nullif(F.col("monetary_value").cast("double"), F.lit(0.0)),
                   F.col("f_monetary").cast("double"), F.lit(0.0)).alias("monetary_value"),
        F.col("f_discount").cast("double").alias("discount_sensitivity"),
        F.least((F.col("browse_events") + F.col("orders")) / 12, F.lit(1.0)).alias("engagement_depth"),
    )
    return churn_scores(inputs, keep=[c for c in inputs.columns if c != "customer_id"])


def rfm_segments(features: DataFrame) -> DataFrame:
    """M10 on every row; missing inputs default to 30 / 1 / 0."""
    r = F.coalesce(F.col("recency_days").cast("double"), F.lit(30.0))
    f = F.coalesce(F.col("frequency").cast("double"), F.lit(1.0))
    m = F.coalesce(F.col("monetary_value").cast("double"), F.lit(0.0))
    return features.select("customer_id", rfm_segment(r, f, m).alias("segment"))


def features_with_precedence(sources: list[tuple[str, DataFrame]], key: str = "customer_id") -> DataFrame:
    """The first source holding a customer wins as a whole record.

    One partial+final aggregate (``min_by`` on the priority) instead of a
    window sort, so a customer present in every source costs one row per
    map task through the shuffle.
    """
    tagged = None
    for priority, (name, df) in enumerate(sources):
        part = df.withColumn("source", F.lit(name)).withColumn("_priority", F.lit(priority))
        tagged = part if tagged is None else tagged.unionByName(part, allowMissingColumns=True)
    value_cols = [c for c in tagged.columns if c not in (key, "_priority")]
    best = tagged.groupBy(key).agg(F.min_by(F.struct(*value_cols), F.col("_priority")).alias("_rec"))
    return best.select(key, *[F.col("_rec")[c].alias(c) for c in value_cols])
