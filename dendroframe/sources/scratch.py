"""Cutting lineage in loops: a checkpoint in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _ready(spark: SparkSession) -> None:
    """Sees to a checkpoint folder: spark.checkpoint.dir; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        known = spark.conf.get("spark.checkpoint.dir", None)
        if not known and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(known or tempfile.mkdtemp(prefix="checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows with a plan of their own, written to the checkpoint folder."""
    _ready(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the checkpoint folder, which all executors share."""
    _ready(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
