"""Intermediate tables in the folder that driver and executors share.

The folder is named by ``spark.checkpoint.dir``; only on a local master, where all
run on one machine, may it be unset.  A written table cuts the lineage and
survives the loss of executors.  ``drop`` removes tables that nothing reads any more.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark then drops the shuffle files of a plan at the end of its run.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a batch of rows that a Python task gets; a single row may be longer.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="spark-scratch-"))
    return f"file://{_local[0]}"


@contextmanager
def freed_shuffles(spark: SparkSession):
    """What runs inside leaves no shuffle files behind: its result is written, so no later plan reads them.  Its Python tasks get small batches."""
    ours = {_CLEANUP: "true", _BATCH: str(BATCH_BYTES)}
    old = {k: spark.conf.get(k, None) for k in ours}
    for k, v in ours.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes written tables whose readers have all been written themselves."""
    for t in tables:
        drop_path(t.sparkSession, t._scratch_path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a folder of written tables."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def tasks_for(df: DataFrame) -> int:
    """How many tasks to deal df's rows out to: no fewer than it is read in, so that a task's share does not grow with the table."""
    return max(shuffle_partitions(df.sparkSession), df.rdd.getNumPartitions())
