"""Reading the input tables.

Tables are Parquet, one directory or file per table. Reads never infer a
schema and never pull rows to the driver; column pruning and predicate
pushdown are left to the Parquet scan.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table_path(sf_dir: str, name: str) -> str:
    path = os.path.join(sf_dir, f"{name}.parquet")
    return path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}")
    return spark.read.parquet(table_path(sf_dir, name))


SPREAD_ROWS = 20_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over all cores when its files give few cores most
    of the rows (a file of one large row group is one task's work), for work
    per row that costs far more than moving the row. Only row counts are read
    to decide; a well laid out or small table is returned as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    most, total = df.groupBy(F.spark_partition_id().alias("_p")).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.max("_n"), F.sum("_n")).first()
    if not total or total < cores * 100 or most * cores <= 2 * total and most <= 4 * SPREAD_ROWS:
        return df
    return df.repartition(max(3 * cores, -(-total // SPREAD_ROWS)), *keys)


class Tables:
    """Lazy accessor: ``Tables(spark, dir).lineitem`` is a DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        return read_table(self.spark, self.sf_dir, name)
