"""Small helpers of the operators: stable copies, the shared folder, text preparation."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    Where none is set, a local session gets a temporary one, which goes when
    Python ends; on a cluster, whose machines could not share it, this raises.
    """
    context = spark.sparkContext
    folder, current = spark.conf.get("spark.checkpoint.dir", None), context._jsc.sc().getCheckpointDir()
    if not folder:
        if current.isDefined():
            return current.get()
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        folder = tempfile.mkdtemp(prefix="tokenlake-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if not current.isDefined():
        context.setCheckpointDir(folder)
    return folder


def stable(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read from there.

    Later passes then see the same rows in the same partitions, and lost
    executors cost no more than the task at hand.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of jobs that are over and done with.

    It does so when the driver collects garbage, which may take long; a sequence of
    steps, each written to the shared folder, would fill the executors' disks meanwhile.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder at the end of the program, if this is still the program and Spark is still there."""

    def go(pid: int = os.getpid()) -> None:
        if os.getpid() == pid and spark.sparkContext._jsc is not None:
            remove(spark, path)

    atexit.register(go)


def fresh(prefix: str) -> str:
    """A column name that no input has."""
    return f"__{prefix}_{uuid.uuid4().hex[:8]}"


def normalized(text: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one space, no outer space; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


#: Rows of an Arrow batch where the rest of a row waits in the JVM for what Python says.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches made small enough for whole texts, unless they are small already.

    For column functions of texts: a batch is held by the JVM, with all other columns,
    and by the Python worker at once.  The setting stays, as the plan that needs it
    runs when the caller wants it to.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH)) <= BATCH_ROWS:
        conf.set(_BATCH, str(BATCH_ROWS))
    return df
