"""Feature documents at the JSON edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def encode_features(features: DataFrame, key: str = "customer_id") -> DataFrame:
    """Scalar features -> one JSON document per customer."""
    cols = [c for c in features.columns if c != key]
    return features.select(key, F.to_json(F.struct(*cols)).alias("features_json"))


def decode_features(docs: DataFrame, schema: T.StructType, key: str = "customer_id") -> DataFrame:
    """JSON document -> typed feature columns."""
    parsed = docs.select(key, F.from_json("features_json", schema).alias("_f"))
    return parsed.select(key, *[F.col(f"_f.{f.name}").alias(f.name) for f in schema.fields])


def scalar_only(docs: DataFrame, col: str = "features_json") -> DataFrame:
    """P10: keep str/bool/int/float values; drop null, list and object
    values.  A value's kind is taken from the raw JSON, where a string has its
    quotes, so a string that starts with a bracket stays."""
    raw = F.from_json(F.col(col), "map<string, variant>")
    kind = lambda v: F.schema_of_variant(v)
    kept = F.map_filter(raw, lambda k, v: v.isNotNull() & ~F.is_variant_null(v) & ~kind(v).startswith("ARRAY") & ~kind(v).startswith("OBJECT"))
    return docs.withColumn("features", F.transform_values(kept, lambda k, v: F.variant_get(v, "$", "string")))
