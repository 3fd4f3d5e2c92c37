"""Exact row numbers within groups that may be huge (W1, W2 building block).

``Window.partitionBy(g)`` sends a whole group to one task. When one group can
hold a third of all rows that task becomes the job. :func:`group_rank` gives the
same numbers: ordinary groups take the window; rows of *hot* groups are
range-partitioned by (group, full order), numbered densely across tasks, and a
row's rank is its number minus that of its group's first row. A hot group is
thus cut into as many pieces as its size asks for, also when all its first
order values are equal.

A group is hot above a threshold that grows with the table, so at most
``MAX_HOT_GROUPS`` groups can be hot and their table (keys and a number) is
bounded and broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .indexing import global_index
from .lineage import materialize

DEFAULT_HOT_ROWS = 2_000_000
HOT_ROWS_CONF = "threadmetrics.hotGroupRows"
MAX_HOT_GROUPS = 100_000


def group_rank(df: DataFrame, group_cols: list[str], order_cols: list[str],
               rank_col: str = "rank", size_col: str = "n",
               hot_rows: int | None = None, pieces: int | None = None) -> DataFrame:
    """``df`` plus ``rank_col`` (1-based position within the group by
    ``order_cols``, ascending, which must be a total order) and ``size_col``
    (group size). ``pieces``: range partitions for hot groups (the session's
    shuffle partitions by default)."""
    spark = df.sparkSession
    if hot_rows is None:
        hot_rows = int(spark.conf.get(HOT_ROWS_CONF, str(DEFAULT_HOT_ROWS)))
    total, largest = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_gn")).agg(
        F.sum("_gn"), F.max("_gn")).first()
    limit = max(hot_rows, -(-(total or 0) // MAX_HOT_GROUPS))

    def windowed(rows: DataFrame) -> DataFrame:
        by = Window.partitionBy(*group_cols)
        return (rows.withColumn(rank_col, F.row_number().over(by.orderBy(*order_cols)).cast("bigint"))
                .withColumn(size_col, F.count(F.lit(1)).over(by).cast("bigint")))

    if (largest or 0) <= limit:
        return windowed(df)
    hot = materialize(df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_gn"))
                      .filter(F.col("_gn") > limit), "hot-groups")
    few = F.broadcast(hot.withColumnsRenamed({g: f"_g{i}" for i, g in enumerate(group_cols)}))   # <= MAX_HOT_GROUPS rows
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group_cols)]
    tagged = df.join(few, same, "left").drop(*[f"_g{i}" for i in range(len(group_cols))])
    cold = windowed(tagged.filter(F.col("_gn").isNull()).drop("_gn"))
    numbered = global_index(tagged.filter(F.col("_gn").isNotNull()), [*group_cols, *order_cols], "_at", partitions=pieces)
    firsts = (numbered.groupBy(*group_cols).agg(F.min("_at").alias("_first"))
              .withColumnsRenamed({g: f"_g{i}" for i, g in enumerate(group_cols)}))
    ranked = (numbered.join(F.broadcast(firsts), same)
              .withColumn(rank_col, (F.col("_at") - F.col("_first") + 1).cast("bigint"))
              .withColumn(size_col, F.col("_gn").cast("bigint")))
    return cold.unionByName(ranked.select(*cold.columns))
