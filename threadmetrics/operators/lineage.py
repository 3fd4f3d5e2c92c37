"""Cutting lineage in iterative jobs.

An iterative job (pointer jumping, doubling) would otherwise grow its plan
every round and, after a lost executor, recompute every earlier round. Each
round's state is written as a Parquet table below the shared folder named by
``spark.checkpoint.dir`` and read back: the plan restarts from a scan, the
data survives executor loss, and the next round reads it column-pruned and
vectorised. (``DataFrame.checkpoint()`` would store Java-serialised rows
instead of a columnar, compressed table.)
"""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def clean_shuffles(spark: SparkSession):
    """Shuffle files of a finished query are deleted at once, not at some later
    garbage collection: a stored table's files are of no use to the next step."""
    before = spark.conf.get(FILE_CLEANUP)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(FILE_CLEANUP, before)


def materialize(df: DataFrame, name: str = "state") -> DataFrame:
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark)
    path = os.path.join(root, f"tm-{name}-{uuid.uuid4().hex}")
    with clean_shuffles(spark):
        df.write.mode("overwrite").parquet(path)
    stored = spark.read.parquet(path)
    stored._tm_path = path
    return stored


def delete(spark: SparkSession, path: str) -> None:
    """Remove a stored table, in whatever store its path names."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def same_table(df: DataFrame, stored: DataFrame) -> DataFrame:
    """``df``, read from the table behind ``stored`` alone, for :func:`release`."""
    df._tm_path = getattr(stored, "_tm_path", None)
    return df


def release(df: DataFrame) -> None:
    """Delete the table behind a frame that :func:`materialize` returned, once
    everything computed from it has been written; other frames are left alone."""
    path = getattr(df, "_tm_path", None)
    if path:
        delete(df.sparkSession, path)
