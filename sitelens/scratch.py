"""Tables that cut lineage: Parquet in the folder all executors share.

A job that loses executors rereads these tables instead of recomputing
everything before them. They are deleted when the session's JVM ends.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LEAST_TASK = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where it is unset and the master is ``local`` (tests), a temporary folder
    is made once per application; on a cluster that is an error, as executors
    can't see each other's local folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = tempfile.mkdtemp(prefix="sitelens-")
    return f"file://{_local[context.applicationId]}"


def tidy(spark: SparkSession) -> None:
    """Collect the driver's garbage once its heap takes over half of what it may.

    A job of hundreds of steps leaves plans and broadcasts behind faster than the
    JVM looks for them, and the heap grows to its limit instead; what is left after
    the collection is a small part, and the heap shrinks to it.
    """
    jvm = spark.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() * 2 > heap.maxMemory():
        gc.collect()  # plans that Python still refers to in cycles
        jvm.java.lang.System.gc()


def table(df: DataFrame, label: str, dear: bool = False) -> DataFrame:
    """Write ``df`` as a shared Parquet table and return a reader of it.

    Shuffle files of the writing query are released when it ends, so the disk
    that several steps need is that of the largest one, not the sum. ``dear`` rows
    take long for their size: their shuffles are dealt to tasks of 64 KB upwards.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sitelens/{label}-{uuid.uuid4().hex}"
    wanted = {_CLEANUP: "true"} | ({_LEAST_TASK: "64k"} if dear else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    tidy(spark)
    return out


def release(df: DataFrame) -> None:
    """Delete a shared table that ``table`` returned and no later step reads."""
    jvm = df.sparkSession.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
    where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
