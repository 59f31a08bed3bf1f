"""Review intelligence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions import sentiment as S
from basketry.sources.views import NEGATIVE_WORDS, POSITIVE_WORDS


def score_reviews(reviews: DataFrame, positive=POSITIVE_WORDS, negative=NEGATIVE_WORDS) -> DataFrame:
    """M15 on every review; a stored label (``sentiment_label``) wins."""
    words = S.tokens(F.col("text"))
    staged = reviews.withColumn("_w", words)
    staged = staged.withColumn("positive_terms", S.hits(F.col("_w"), positive)) \
                   .withColumn("negative_terms", S.hits(F.col("_w"), negative))
    sc = S.score(F.size("_w"), F.size("positive_terms"), F.size("negative_terms"))
    out = staged.withColumn("score", sc).drop("_w")
    computed = S.label(F.col("score"))
    lab = F.coalesce(F.col("sentiment_label"), computed) if "sentiment_label" in reviews.columns else computed
    return out.withColumn("label", lab)


def sentiment_mix(scored: DataFrame, by: str | None = "product_id") -> DataFrame:
    """Share of each label, per ``by`` value and overall (by = null).

    One aggregate at (by, label) grain; the overall rows are re-aggregated
    from it, so the review table is read once.  Reviews without a ``by``
    value are a group of their own, told from the overall rows by ``level`` (each or overall).
    """
    grain = scored.groupBy(by, "label").agg(F.count(F.lit(1)).alias("review_count")) \
                  .withColumn("level", F.lit("each"))
    overall = grain.groupBy("label").agg(F.sum("review_count").alias("review_count")) \
                   .withColumn(by, F.lit(None).cast(scored.schema[by].dataType)) \
                   .withColumn("level", F.lit("overall"))
    both = grain.unionByName(overall)
    total = F.sum("review_count").over(Window.partitionBy("level", by))
    return both.withColumn("total", total).select(
        "level", by, "label", F.col("review_count").cast("bigint").alias("review_count"),
        F.round(F.col("review_count") / F.greatest(F.col("total"), F.lit(1)), 3).alias("share"))


def recent_reviews(scored: DataFrame, n: int = 20) -> DataFrame:
    """Newest n reviews (T2o)."""
    return scored.orderBy(F.desc("created_at"), F.desc("review_id")).limit(n)
