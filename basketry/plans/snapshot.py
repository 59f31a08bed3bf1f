"""Customer snapshot (M22): features, rule segment, churn, behaviour and
relationship count for every customer.

The behaviour table feeds two branches (churn and the snapshot itself), the
features three.  Both are written once, one row a customer, in the session's shared
checkpoint folder, so a lost executor re-reads them instead of re-running the
sales joins.  (``checkpoint()`` would run the behaviour's last step twice.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators.behavior import customer_behavior
from basketry.operators.churn import customer_churn, rfm_segments
from basketry.operators.graph import GraphInputs, relationship_summary
from basketry.session import materialize as write_and_read


def customer_snapshot(sales: DataFrame, views: DataFrame, features: DataFrame, as_of,
                      materialize: bool = True) -> DataFrame:
    behavior = customer_behavior(sales, views, as_of)
    if materialize:
        behavior = write_and_read(behavior, "behavior")
        features = write_and_read(features, "features")
    churn = customer_churn(behavior, features).select("customer_id", "probability", "risk_band")
    seg = rfm_segments(features)
    rel = relationship_summary(GraphInputs(sales, views)).select("customer_id", "relationship_count")
    b = behavior.select("customer_id", "orders", "browse_events", "monetary_value", "recency_days", "behavior_segment")
    f = features.select("customer_id", F.col("frequency").alias("feature_frequency"),
                        F.col("monetary_value").alias("feature_monetary"))
    return (f.join(seg, "customer_id", "left").join(b, "customer_id", "left")
             .join(churn, "customer_id", "left").join(rel, "customer_id", "left"))
