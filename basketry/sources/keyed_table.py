"""A stored table with one row per key that batches of changes are merged into
(S11, S12, S13 against what is stored).

Rows lie in parquet folders by key bucket.  A merge reads the buckets its changes
fall into, combines stored rows with changes and writes those buckets anew in a
folder named by the batch; then a small file that says where each bucket lies
is put in place whole, which switches readers to the new version at once.  A
batch that was merged before changes nothing; one that failed is merged again
from the version before it.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.session import file_system
from basketry.streaming.manifest import mark, marks


class KeyedTable:
    """``combine(stored, changes)`` of a merge gets the stored rows of the changes'
    buckets and returns all rows that these buckets then have, in ``schema``."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, buckets: int = 64):
        self.spark, self.path, self.keys, self.schema, self.buckets = spark, path.rstrip("/"), keys, schema, buckets

    def _version(self) -> tuple[int, dict[str, str]]:
        """(last merged batch, bucket -> folder); (-1, {}) before the first."""
        names = marks(self.spark, f"{self.path}/versions")
        if not names:
            return -1, {}
        fs, of = file_system(self.spark, self.path)
        stream = fs.open(of(f"{self.path}/versions/{names[-1]}"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return int(names[-1]), json.loads(text)

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def read(self) -> DataFrame:
        return self._read(sorted(self._version()[1].values()))

    def merge(self, changes: DataFrame, batch: int, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """Whether the batch, numbered upwards from 0, was new and is merged now."""
        last, places = self._version()
        if batch <= last:
            return False
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = sorted(r[0] for r in changes.select(bucket.alias("b")).distinct().collect())  # as many as buckets
        stored = self._read([places[str(b)] for b in touched if str(b) in places])
        folder = f"{self.path}/data/batch={batch:020d}"
        rows = combine(stored, changes).withColumn("bucket", bucket)
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        mark(self.spark, f"{self.path}/versions", f"{batch:020d}", json.dumps(places | {str(b): f"{folder}/bucket={b}" for b in touched}))
        return True
