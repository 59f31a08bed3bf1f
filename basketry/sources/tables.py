"""Parquet table access for the driver's fixture tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basketry.session import bound_tasks, stored_bytes, tasks_of, use_utc

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


class TableSet:
    """Lazily opened parquet tables under one directory.

    Reads are plain ``spark.read.parquet`` so that Catalyst pushes filters and
    prunes columns into every scan.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._cache: dict[str, DataFrame] = {}
        self._bytes = 0
        use_utc(spark)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        if name not in TABLE_NAMES:
            raise KeyError(f"unknown table {name!r}")
        # one relation per table and TableSet: resolved (listed, footers
        # read) once, and identical plans let Spark reuse exchanges
        if name not in self._cache:
            self._bytes += stored_bytes(self.spark, self.path(name))
            bound_tasks(self.spark, self._bytes)
            self._cache[name] = self.spark.read.parquet(self.path(name))
        return self._cache[name]

    def tasks(self) -> int:
        """Into how many parts rows joined from the tables opened so far are dealt."""
        return max(tasks_of(self._bytes), self.spark.sparkContext.defaultParallelism)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_NAMES:
            return self.table(name)
        raise AttributeError(name)
