"""Rule-based scores and segment labels as column expressions (M1, M8-M10,
M12, M17-M19).  Weights, thresholds and label texts below are fixed values
that must equal the reference's for identical results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: churn model (M1) --------------------------------------
# weights: recency .42, frequency .24, monetary .12, discount .14, engagement .08
# scales: recency / 120 days, frequency / 12 orders, monetary / 20000
# defaults: recency 30, frequency 1, monetary 0, discount .35, engagement .5
# probability clamp [.02, .96], rounded to 3; bands: >= .65 high, >= .35 medium
CHURN_ACTIONS = {
    "high": "Trigger win-back offer and human review.",
    "medium": "Send personalized retention offer.",
    "low": "Maintain normal personalized recommendations.",
}


def churn_components(recency: Column, frequency: Column, monetary: Column,
                     discount: Column, engagement: Column) -> dict[str, Column]:
    r = F.coalesce(recency.cast("double"), F.lit(30.0))
    f = F.coalesce(frequency.cast("double"), F.lit(1.0))
    m = F.coalesce(monetary.cast("double"), F.lit(0.0))
    d = F.coalesce(discount.cast("double"), F.lit(0.35))
    e = F.coalesce(engagement.cast("double"), F.lit(0.5))
    return {
        "recency_days": F.least(r / 120, F.lit(1.0)) * 0.42,
        "frequency": F.greatest(F.lit(0.0), 1 - F.least(f / 12, F.lit(1.0))) * 0.24,
        "monetary_value": F.greatest(F.lit(0.0), 1 - F.least(m / 20000, F.lit(1.0))) * 0.12,
        "discount_sensitivity": F.least(d, F.lit(1.0)) * 0.14,
        "engagement_depth": F.greatest(F.lit(0.0), 1 - F.least(e, F.lit(1.0))) * 0.08,
    }


def churn_probability(components: dict[str, Column]) -> Column:
    risk = (components["recency_days"] + components["frequency"] + components["monetary_value"]
            + components["discount_sensitivity"] + components["engagement_depth"])
    return F.round(F.greatest(F.lit(0.02), F.least(risk, F.lit(0.96))), 3)


def churn_band(probability: Column) -> Column:
    return (F.when(probability >= 0.65, F.lit("high"))
            .when(probability >= 0.35, F.lit("medium"))
            .otherwise(F.lit("low")))


def churn_action(band: Column) -> Column:
    return (F.when(band == "high", F.lit(CHURN_ACTIONS["high"]))
            .when(band == "medium", F.lit(CHURN_ACTIONS["medium"]))
            .otherwise(F.lit(CHURN_ACTIONS["low"])))


# ---- fixed values: RFM rule segment (M10) ---------------------------------
# high_ltv_active: monetary >= 10000 and frequency >= 8 and recency <= 30
# winback_risk: recency > 90; loyal_growth: frequency >= 5; else emerging
def rfm_segment(recency: Column, frequency: Column, monetary: Column) -> Column:
    return (F.when((monetary >= 10000) & (frequency >= 8) & (recency <= 30), F.lit("high_ltv_active"))
            .when(recency > 90, F.lit("winback_risk"))
            .when(frequency >= 5, F.lit("loyal_growth"))
            .otherwise(F.lit("emerging")))


# ---- fixed values: cluster labelling (M12) --------------------------------
# high_ltv_active: avg monetary >= 12000 and avg frequency >= 7 and avg recency <= 30
# winback_risk: avg recency >= 90; loyal_growth: avg frequency >= 5; else emerging
def cluster_label(avg_recency: Column, avg_frequency: Column, avg_monetary: Column) -> Column:
    return (F.when((avg_monetary >= 12000) & (avg_frequency >= 7) & (avg_recency <= 30), F.lit("high_ltv_active"))
            .when(avg_recency >= 90, F.lit("winback_risk"))
            .when(avg_frequency >= 5, F.lit("loyal_growth"))
            .otherwise(F.lit("emerging")))


# ---- fixed values: behaviour segment (M9) ---------------------------------
# loyal_active_buyer: >= 5 orders and recency <= 30; '<top category>_affinity';
# winback_risk: recency >= 90; else emerging_customer
def behavior_segment(orders: Column, recency: Column, top_category: Column) -> Column:
    return (F.when((orders >= 5) & (recency <= 30), F.lit("loyal_active_buyer"))
            .when(top_category.isNotNull(), F.concat(top_category, F.lit("_affinity")))
            .when(recency >= 90, F.lit("winback_risk"))
            .otherwise(F.lit("emerging_customer")))


# ---- fixed values: graph segment label (M19) ------------------------------
# 'Loyal active buyer' for >= 5 orders; '<top> affinity'; 'Emerging customer'
def graph_segment_label(orders: Column, top_category: Column) -> Column:
    return (F.when(orders >= 5, F.lit("Loyal active buyer"))
            .when(top_category.isNotNull(), F.concat(top_category, F.lit(" affinity")))
            .otherwise(F.lit("Emerging customer")))


# ---- fixed values: account segment (M18) ----------------------------------
# >= 5 orders 'Loyal repeat buyer'; then wellness 'Wellness shopper', commuter
# 'Commuter shopper', smart home 'Smart home shopper'; else 'Active shopper'
def account_segment(order_count: Column, categories: Column) -> Column:
    return (F.when(order_count >= 5, F.lit("Loyal repeat buyer"))
            .when(F.array_contains(categories, "wellness"), F.lit("Wellness shopper"))
            .when(F.array_contains(categories, "commuter"), F.lit("Commuter shopper"))
            .when(F.array_contains(categories, "smart home"), F.lit("Smart home shopper"))
            .otherwise(F.lit("Active shopper")))


# ---- fixed values: segment fit of a product (M8) --------------------------
# 'wellness' in segment and categories meet {wellness, fitness, sleep} -> 1.0
# 'commuter' in segment and categories meet {commuter, travel}         -> 1.0
# 'home' in segment and 'smart home' in categories                      -> 1.0
# 'productivity' in segment and 'productivity' in categories            -> 1.0
# 'active shopper' in segment                                           -> 0.5
# otherwise 0.0
def segment_fit(normalized_segment: Column, categories: Column) -> Column:
    def meets(values):
        return F.arrays_overlap(categories, F.array(*[F.lit(v) for v in values]))
    return (F.when(normalized_segment.contains("wellness") & meets(["wellness", "fitness", "sleep"]), F.lit(1.0))
            .when(normalized_segment.contains("commuter") & meets(["commuter", "travel"]), F.lit(1.0))
            .when(normalized_segment.contains("home") & F.array_contains(categories, "smart home"), F.lit(1.0))
            .when(normalized_segment.contains("productivity") & F.array_contains(categories, "productivity"), F.lit(1.0))
            .when(normalized_segment.contains("active shopper"), F.lit(0.5))
            .otherwise(F.lit(0.0)))


# ---- fixed values: segment-category match (M17) ---------------------------
# category contained in segment -> 1; 'wellness' and category in {wellness, sleep};
# 'home' and 'smart home'; 'commuter' and category in {commuter, travel}; else 0
def segment_category_match(normalized_segment: Column, category: Column) -> Column:
    return (F.when(F.coalesce(category, F.lit("")) == "", F.lit(0.0))
            .when(F.instr(normalized_segment, category) > 0, F.lit(1.0))
            .when(normalized_segment.contains("wellness") & category.isin("wellness", "sleep"), F.lit(1.0))
            .when(normalized_segment.contains("home") & (category == "smart home"), F.lit(1.0))
            .when(normalized_segment.contains("commuter") & category.isin("commuter", "travel"), F.lit(1.0))
            .otherwise(F.lit(0.0)))


def normalize_segment(segment: Column) -> Column:
    return F.regexp_replace(F.lower(segment), "_", " ")
