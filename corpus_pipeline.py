"""A training corpus from raw documents, in five stages.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read again as the next
one's docs.  Every stage works on all that its predecessor kept.

1. language: documents whose language cannot be told (no letters, or too far
   from every known language) go.
2. quality: documents that the classifier scores below one half go.
3. near duplicates: one document of each group of linked documents stays.
4. secrets: found spans are masked in the text; documents stay.
5. packing: the rest becomes windows of 1024 tokens, one row per piece.

All stages but the last return the columns of ``docs``, also where those have
names that the operators use.  Null texts are empty; without letters they go
in the first stage.  Repeated rows are near duplicates of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import language_id, ngram_join, quality, secret_scan
from basketry.llm.common import read
from basketry.llm.queries import language_model, packed_documents, quality_model
from basketry.session import materialize


def _kept(found: DataFrame, docs: DataFrame, keep) -> DataFrame:
    """Rows of ``found``, which begins with the columns of ``docs`` under
    positional names, that ``keep`` takes; with their own names again."""
    return found.where(keep).select(*(F.col(f"c{i}").alias(name) for i, name in enumerate(docs.columns)))


def _positional(docs: DataFrame) -> tuple[DataFrame, str, str, tuple[str, ...]]:
    """Docs with positional names, those of id and text, and of all others than the id."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = names[docs.columns.index("doc_id")]
    return docs.toDF(*names), own, names[docs.columns.index("text")], tuple(n for n in names if n != own)


def tell_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    table, own, text, rest = _positional(docs)
    found = language_id.predict(table, language_model(docs.select("doc_id", "text", "lang")), own, text, rest)
    return _kept(found, docs, ~F.col("rejected"))


def tell_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    table, own, text, rest = _positional(docs)
    model = quality_model(docs.select("doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "quality"))
    return _kept(quality.score(table, model, own, text, rest), docs, F.col("predicted") == 1)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # a number for every row, so that rows without an id and repeated rows count as documents too
    numbered = docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).withColumn("row", F.monotonically_increasing_id())
    groups = ngram_join.near_duplicates(numbered, "row", f"c{docs.columns.index('text')}")
    first = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("row"))
    return _kept(numbered.join(first, "row", "left_semi"), docs, F.lit(True))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secret_scan.redact(docs)
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_documents(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", tell_language),
    ("quality", tell_quality),
    ("near_duplicates", one_of_each_group),
    ("secrets", mask_secrets),
    ("packing", pack_windows),
]

#: Models and tokenisers cannot be said in SQL; tests/llm has brute-force twins.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
