"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session without that setting gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpusloom-checkpoint-"))
    return jsc.getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """df with its lineage cut: rows come from the shared folder, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, as a URI; what is there goes when this driver ends, and may go before by removed().

    What a query writes there it may read as late as its rows are asked for, so nothing earlier can take it away.
    """
    root = shared_dir(spark)
    root = f"file://{root}" if root.startswith("/") else re.sub("^file:/+", "file:///", root)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    @atexit.register
    def gone() -> None:
        # The JVM may have ended before; then the folder stays.
        with contextlib.suppress(Exception):
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)

    return path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this session has written and needs no more, in whatever store it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(spark: SparkSession, path: str) -> bool:
    """Whether there is a table at path that its writer has finished."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)
