"""Session helper and the shared working folder."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators count on.  Joins carry no size hints unless a
# bound is proven; adaptive execution measures a side before broadcasting it.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows of numbers go to Python in batches of this size, whatever a query before has set.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}


def build_session(app: str = "sensorgrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def apply_runtime_conf(spark: SparkSession) -> SparkSession:
    """Set what may be set on a running session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or one in the warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir')}/working/{spark.sparkContext.applicationId}"
    return root.rstrip("/")


def run_dir(spark: SparkSession, name: str) -> str:
    """A new, so far unused folder for one run of ``name``."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage of a frame that is used several times.  The table outlives lost
    executors, is read by column and has a size the optimizer knows.
    """
    path = run_dir(df.sparkSession, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system, if it is there."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


@contextmanager
def local_state_width(spark: SparkSession):
    """Streams started inside keep at most one state partition per core.

    Stream state is not coalesced at run time, so the session's width is what every
    micro-batch pays for.
    """
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def wide(spark: SparkSession) -> int:
    """Task count for work that is heavy per row: two for each core.

    Adaptive execution would size such tasks by their bytes, which say little here.
    """
    return 2 * spark.sparkContext.defaultParallelism


def spread_if_small(df: DataFrame, *keys) -> DataFrame:
    """``df`` dealt over all cores by ``keys`` where its scans have too few partitions for work that is heavy per row.

    Tables of two scan partitions for each core or more stay where they are read: that is wide enough, and
    a shuffle would move all rows.  Frames of unknown size are dealt.
    """
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    enough = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()) * wide(spark)
    # Leaves of unknown size count as far more than any table has.
    return df if enough <= sum(sizes) < 1 << 60 else df.repartition(wide(spark), *keys)
