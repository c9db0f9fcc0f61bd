"""Where iterative plans cut their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder that the cluster names in spark.checkpoint.dir, and read back. Only a local session
    without one gets a folder of its own."""
    _named(df.sparkSession)
    return df.checkpoint()


def _named(spark: SparkSession) -> str | None:
    """The setting, and a checkpoint folder by it."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not spark.sparkContext.getCheckpointDir():
        if not shared and (not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return shared


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's address below the shared folder, for files that a job leaves to later ones."""
    shared = _named(spark) or spark.sparkContext.getCheckpointDir()
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
