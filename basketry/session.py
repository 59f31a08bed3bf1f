"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings the operators assume.  AQE re-plans joins from runtime sizes and
# splits skewed shuffle partitions; the session zone is UTC because every
# timestamp in the data model is UTC.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # streaming state off-heap and checkpointed incrementally
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "basketry", extra: dict | None = None) -> SparkSession:
    """A session with the settings above.  Master and partition count are left
    to spark-submit and the cluster unless they are passed."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_utc(spark: SparkSession) -> None:
    """All operators read and write UTC instants (the reference pins UTC too)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


#: Most bytes of shuffled rows or of a table's file that one task reads.
TASK_BYTES = 16 << 20


def bound_tasks(spark: SparkSession, input_bytes: int) -> None:
    """What a task sorts or aggregates stays the same however large the tables are:
    scans and shuffles are dealt by bytes, and shuffles begin with so many
    partitions that those of ``input_bytes`` can be as small.  Smaller settings
    of the session, and more partitions, are left."""
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for name in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"):
        if size(spark.conf.get(name)) > TASK_BYTES:
            spark.conf.set(name, str(TASK_BYTES))
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    wanted = tasks_of(input_bytes)
    if wanted > int(spark.conf.get(name, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(name, str(wanted))


def tasks_of(input_bytes: int) -> int:
    # a row's columns may be shuffled several times their size in the table
    return 4 * input_bytes // TASK_BYTES


def stored_bytes(spark: SparkSession, path: str) -> int:
    fs, of = file_system(spark, path)
    return fs.getContentSummary(of(path)).getLength()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Reads ``spark.checkpoint.dir`` from the session.  Where it is unset, a
    private temporary folder is made on a local master; on a cluster that is an
    error, because executors would not share the folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="basketry-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def file_system(spark: SparkSession, path: str):
    """(the file system that a path names, Hadoop's path type)."""
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), of


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store it names."""
    fs, of = file_system(spark, path)
    return fs.exists(of(path))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base.rstrip("/"), "tables", name)


def materialize(df, name: str):
    """Cut a reused intermediate from its lineage by writing it as a parquet
    table in the shared checkpoint folder and reading it back.

    Columnar and splittable, so it is cheaper than ``Dataset.checkpoint()``
    (which serialises rows through an RDD), and a lost executor re-reads the
    table instead of recomputing the upstream joins."""
    import uuid
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def materialize_by(df, key: str, tasks: int, name: str):
    """``materialize`` with the rows dealt by ``key`` into ``tasks`` buckets: what is
    grouped, numbered or united by columns with ``key`` among them is then not
    shuffled.  A bucket that a large key fills is written by several tasks."""
    import uuid
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    path = scratch_path(spark, table)
    df.hint("rebalance", tasks, key).write.format("parquet").bucketBy(tasks, key).option("path", path).saveAsTable(table)
    stored = spark.table(table)
    # buckets are only known of tables; the frame has them now, and the files stay
    spark.sql(f"DROP TABLE {table}")
    # a union knows the buckets by columns without the table's name only
    return stored.select(*(stored[c].alias(c) for c in stored.columns))


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go with the execution that made them, so that the disk holds
    those of one step of a job and not of all steps before.  For steps that are
    written once: a DataFrame that is executed again shuffles again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
