"""Intermediate tables in the folder that driver and executors share.

A stored table is deleted by `discard` as soon as no plan reads it any more, or else when the driver's program ends.
"""

from __future__ import annotations

import atexit
import gc
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

#: Stands in for spark.checkpoint.dir where a session in one process has none, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"

_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_left: dict[str, SparkSession] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share; a cluster must name that folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = LOCAL_CHECKPOINTS
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new shared path whose content goes when the driver's program ends."""
    path = shared_path(spark, name)
    if not _left:
        atexit.register(_clear)
    _left[path] = spark
    return path


def materialized(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again: computed once, and lineage ends here whatever executor is lost."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def release(spark: SparkSession) -> None:
    """Let the driver notice which shuffles of finished jobs nobody refers to any more, so that their files go now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*frames: DataFrame) -> None:
    """Delete tables that materialized() gave and that no plan yet to run reads."""
    for frame in frames:
        _delete(_folders.pop(frame))


def _delete(path: str) -> None:
    spark = _left.pop(path)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def _clear() -> None:
    for path in list(_left):
        try:
            _delete(path)
        except Exception:  # the session or its JVM is gone; what is left is one folder of the shared temporary place
            _left.pop(path, None)
