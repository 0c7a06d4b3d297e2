"""Cutting lineage in the folder that all machines share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where spark.checkpoint.dir is not set, a local master (tests) gets one; a cluster must name one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: it outlives the executors that wrote it."""
    folder(df.sparkSession)
    return df.checkpoint()
