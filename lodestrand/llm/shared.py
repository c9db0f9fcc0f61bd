"""What several operators of this folder share: table access, scratch tables and partition counts."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local one only where it names none and all runs in one process, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(df: DataFrame) -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder and read it back: lineage ends there, and any executor can reread it."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    release_shuffles(spark)
    return spark.read.schema(df.schema).parquet(path), path


def release_shuffles(spark: SparkSession) -> None:
    """Shuffle files of finished work go when the JVM collects their handles; ask for that once a table has replaced them."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    import ctypes

    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return lambda _: 0


def tidy() -> None:
    """In a Python worker: gives memory that is free back to the system, since workers live on after a task."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    _trim()(0)


def drop_scratch(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        with contextlib.suppress(Exception):
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def size_of(df: DataFrame) -> int:
    """Catalyst's estimate of a plan's bytes; scans give their file sizes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(table: DataFrame, most: int = 32 << 20) -> DataFrame:
    """For a written table: a broadcast hint if its files are small, else as it is, for Spark to shuffle."""
    return F.broadcast(table) if size_of(table) <= most else table


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")
