"""Sinks of one stream that readers see batch by batch.

A micro-batch writes several tables, each in a folder of its own named by the
batch, and is marked complete last, by renaming a small file.  Readers take the
folders of complete batches alone, so they see all tables of a batch or none.
A batch that is run again overwrites its folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.session import file_system


def mark(spark: SparkSession, folder: str, name: str, text: str = "") -> None:
    """Creates ``folder/name`` with ``text``, whole or not at all."""
    fs, path = file_system(spark, folder)
    fs.mkdirs(path(folder))
    draft, final = path(f"{folder}/.{name}.draft"), path(f"{folder}/{name}")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(final):
        fs.delete(final, False)
    if not fs.rename(draft, final):
        raise OSError(f"cannot rename {draft} to {final}")


def marks(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files in ``folder`` in order; none if it does not exist."""
    fs, path = file_system(spark, folder)
    if not fs.exists(path(folder)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path(folder))]
    return sorted(n for n in names if not n.startswith("."))


def write_batch(base: str, batch_id: int, tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{base}/{name}/batch_id={batch_id}")
        spark = df.sparkSession
    mark(spark, f"{base}/complete", str(batch_id))


def complete_batches(spark: SparkSession, base: str) -> list[int]:
    return sorted(map(int, marks(spark, f"{base}/complete")))


def read_complete(spark: SparkSession, base: str, name: str, schema) -> DataFrame:
    """The rows that complete batches wrote to a table."""
    done = complete_batches(spark, base)
    if not done:
        return spark.createDataFrame([], schema)
    rows = spark.read.option("basePath", f"{base}/{name}").parquet(f"{base}/{name}")
    return rows.where(F.col("batch_id").isin(done)).drop("batch_id")
