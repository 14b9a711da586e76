"""Lineage cuts in the folder that driver and executors share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


_MADE: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and runs on one machine, as in tests, a local folder is set; elsewhere that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file:///tmp/checkpoints/" + uuid.uuid4().hex
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder, which survives lost executors."""
    shared_dir(df.sparkSession)
    done, made = df.checkpoint(), _MADE.get()
    if made is not None:
        made.append(done)
    return done


def alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """``make()`` checkpointed; all other checkpoints that it made are deleted, and its shuffles are given back."""
    made: list[DataFrame] = []
    token = _MADE.set(made)
    try:
        done = make().checkpoint()
    finally:
        _MADE.reset(token)
        for df in made:
            _delete(df)
        made.clear()
    # Spark gives shuffles back once nothing names them any more, which its cleaner learns from a collection on the driver.
    gc.collect()
    spark._jvm.System.gc()
    return done


def _delete(df: DataFrame) -> None:
    spark = df.sparkSession
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
