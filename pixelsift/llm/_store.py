"""Intermediate tables in the folder that the driver and every executor share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a folder of our own only where it is unset on a local master (tests).
    A cluster's executors don't share such a folder, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _OWN:
        _OWN[key] = "file://" + tempfile.mkdtemp(prefix="pixelsift-")
    return _OWN[key]


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; the JVM removes it when it ends."""
    path = f"{shared_dir(spark)}/pixelsift-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


#: Bytes of a step's inputs for each task that writes its result, at least.
TASK_BYTES = 4 << 20


def fewer(df: DataFrame) -> DataFrame:
    """``df`` in no more tasks than its inputs are worth: one for each :data:`TASK_BYTES` of them, and two for each core.

    Small tables that were dealt over hundreds of tasks are hundreds of files otherwise, and each file costs the
    committer several calls, on a local file system processes too: its permissions are set by a command. Nothing moves;
    a task takes several partitions one after another. Large steps and those of unknown size stay as they are."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, min(size // TASK_BYTES, 1 << 20)))


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a cut in the lineage that survives
    lost executors, whose columns stay prunable and whose size the planner knows."""
    path = shared_path(df.sparkSession, name)
    fewer(df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of steps that are written and done with; else they stay until the
    driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
