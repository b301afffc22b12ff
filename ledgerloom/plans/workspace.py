"""Shared folder for files a job writes, and checkpoints below it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _one_process(spark: SparkSession) -> bool:
    """Whether driver and executor are one, so that a folder of this machine is shared."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def run_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    A temporary folder of this machine is used only when the session names no
    shared folder and runs in local mode.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        if not _one_process(spark):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        shared = tempfile.mkdtemp(prefix="ledgerloom-")
    return f"{shared.rstrip('/')}/ledgerloom/{purpose}-{uuid.uuid4().hex}"


def checkpointed(frame: DataFrame) -> DataFrame:
    """The frame, written once to the folder in spark.checkpoint.dir and read from there.

    Only a local session without that setting gets a folder of its own.
    """
    spark = frame.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if not _one_process(spark):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerloom-"))
    return frame.checkpoint()


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame, written once as parquet to a run folder and read from there. Unlike a checkpoint it is compressed, its size is known to
    the planner and a reader of few columns reads only these; the order of rows and parts is not kept."""
    if "void" in frame.schema.simpleString():  # parquet has no such type
        return checkpointed(frame)
    path = run_folder(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows, known as such to the planner: no task and no Python worker is started for them."""
    return spark.range(0).where(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
