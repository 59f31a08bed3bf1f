"""K-means customer segmentation on the feature table.

Fit on every customer's (recency, frequency, monetary) after standard scaling:
centres are seeded farthest first and moved by Lloyd rounds, each one aggregate
over the stored points, so a fit is the same however the rows lie.  Clusters are
labelled by thresholds on their mean profile (M12); assignment is the nearest
centre in the model's scaled space (M13); the rule segment fills in where a
customer's features are incomplete (M14).  The driver holds k centres only.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.scoring import cluster_label, rfm_segment
from basketry.session import materialize as write_and_read

FEATURES = ("recency_days", "frequency", "monetary_value")
_SCALED = ("z0", "z1", "z2")


@dataclass(frozen=True)
class SegmentModel:
    """Means and deviations of the features, and centres in the scaled space."""

    means: list[float]
    deviations: list[float]
    centers: list[list[float]]

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "model string").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SegmentModel:
        return cls(**json.loads(spark.read.parquet(path).first().model))

    def scaled(self) -> list[Column]:
        return [((F.col(c).cast("double") - m) / s).alias(z) for z, c, m, s in zip(_SCALED, FEATURES, self.means, self.deviations)]


def _distance(center: list[float], cols=_SCALED) -> Column:
    parts = [(F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(cols, center)]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def nearest_centroid(points: DataFrame, centroids: list[list[float]], cols=FEATURES) -> DataFrame:
    """M13 for explicit centroids (already in the points' space): argmin of
    squared distance, ties to the lower index.  The centroid list has k
    entries (bounded by k), so it is evaluated inline per row."""
    dists = [F.struct(_distance(cen, cols).alias("d"), F.lit(i).alias("i")) for i, cen in enumerate(centroids)]
    return points.withColumn("cluster", F.array_min(F.array(*dists))["i"])


def _complete(features: DataFrame) -> DataFrame:
    return features.select("customer_id", *[F.col(c).cast("double").alias(c) for c in FEATURES]).na.drop()


def fit_kmeans(features: DataFrame, k: int = 4, rounds: int = 10) -> SegmentModel:
    """M11 fit over the customers with all features; k is clamped to 2..customers.

    The first centre is the customer nearest the mean, every further one the
    customer farthest from the centres so far (ties: smallest id).  A cluster
    that no customer is nearest to keeps its centre."""
    clean = _complete(features)
    n, *sums = clean.agg(F.count(F.lit(1)), *(F.sum(F.col(c).cast("decimal(18,6)")) for c in FEATURES)).first()
    if not n:
        raise ValueError("no customer has all features")
    means = [float(s) / n for s in sums]
    spread = clean.agg(*(F.sum(((F.col(c) - m) * (F.col(c) - m)).cast("decimal(38,6)")) for c, m in zip(FEATURES, means))).first()
    model = SegmentModel(means, [(float(s) / n) ** 0.5 or 1.0 for s in spread], [])
    points = write_and_read(clean.select("customer_id", *model.scaled()), "points")
    centers = [list(points.orderBy(_distance([0.0, 0.0, 0.0]), "customer_id").select(*_SCALED).first())]
    for _ in range(max(2, min(k, n)) - 1):
        far = F.least(*map(_distance, centers)) if len(centers) > 1 else _distance(centers[0])
        centers.append(list(points.orderBy(far.desc(), "customer_id").select(*_SCALED).first()))
    for _ in range(rounds):
        sums = nearest_centroid(points, centers, _SCALED).groupBy("cluster").agg(
            F.count(F.lit(1)).alias("n"), *(F.sum(F.col(z).cast("decimal(38,12)")).alias(z) for z in _SCALED)).collect()  # k rows
        moved = {r.cluster: [float(r[z]) / r.n for z in _SCALED] for r in sums}
        after = [moved.get(i, c) for i, c in enumerate(centers)]
        if after == centers:
            break
        centers = after
    return SegmentModel(model.means, model.deviations, centers)


def assign(model: SegmentModel, features: DataFrame) -> DataFrame:
    """M11 predict / M13: nearest centre in the scaled space per customer."""
    placed = nearest_centroid(_complete(features).select("*", *model.scaled()), model.centers, _SCALED)
    return placed.select("customer_id", *FEATURES, F.col("cluster").cast("int").alias("cluster"))


def cluster_profiles(assigned: DataFrame) -> DataFrame:
    """Cluster means -> label."""
    prof = assigned.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("members"), F.avg("recency_days").alias("avg_recency"),
        F.avg("frequency").alias("avg_frequency"), F.avg("monetary_value").alias("avg_monetary"))
    return prof.withColumn("label", cluster_label(F.col("avg_recency"), F.col("avg_frequency"), F.col("avg_monetary")))


def materialize(features: DataFrame) -> DataFrame:
    """The feature table is read by the scaler, the points, the assignment and the
    rule fallback: cut it once from its (sales-join) lineage."""
    return write_and_read(features, "features")


def segments(features: DataFrame, k: int = 4) -> DataFrame:
    """M11 + M12 + M14: every customer's k-means segment, rules as fallback."""
    features = materialize(features)
    assigned = assign(fit_kmeans(features, k), features)
    labels = cluster_profiles(assigned).select("cluster", F.col("label").alias("kmeans_segment"))
    rules = features.select("customer_id", rfm_segment(
        F.coalesce(F.col("recency_days").cast("double"), F.lit(30.0)),
        F.coalesce(F.col("frequency").cast("double"), F.lit(1.0)),
        F.coalesce(F.col("monetary_value").cast("double"), F.lit(0.0))).alias("rule_segment"))
    j = rules.join(assigned.select("customer_id", "cluster"), "customer_id", "left").join(F.broadcast(labels), "cluster", "left")
    return j.select("customer_id", "cluster", "kmeans_segment", "rule_segment",
                    F.coalesce("kmeans_segment", "rule_segment").alias("segment"))
