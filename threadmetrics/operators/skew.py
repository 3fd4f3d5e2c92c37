"""Many-to-one lookups where one key may carry a large share of the rows.

A sort-merge join sends all rows of a key to one task. For a lookup
``left.key -> right`` (right unique per key):

* rows with a NULL key never match; they are set aside before the join;
* the left side is written once, counted per key with a partial aggregation,
  and keys above a threshold are salted: their left rows are dealt over
  ``rows of the key / threshold`` parts and their one right-hand row is repeated
  once per part, so no task receives more than about a threshold's worth of
  one key. The threshold grows with the table so that at most ``MAX_HOT_KEYS``
  keys can exceed it: the table of hot keys (keys and a number, no payload) is
  bounded for any input and is broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import materialize

DEFAULT_HOT_ROWS = 1_000_000
HOT_ROWS_CONF = "threadmetrics.hotKeyRows"
MAX_HOT_KEYS = 100_000


def planner_broadcasts(right: DataFrame) -> bool:
    """Is the planner's estimate of ``right`` within its broadcast threshold?
    Then the join is done where the left rows are and no key can be hot."""
    spark = right.sparkSession
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = right._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return 0 <= int(str(size)) <= limit


def largest_group(df: DataFrame, col: str) -> int:
    """Rows of the commonest value of ``col``, null included: no key that holds
    the column has more."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left",
                hot_rows: int | None = None, left_rows: int | None = None) -> DataFrame:
    """``left.join(right, keys, how)`` (left, inner or left_semi) for a
    ``right`` unique per key. ``left_rows``, when the caller already knows an
    upper bound of the rows of a key (the left size, or the size of the largest
    thread where every key holds its post), skips the key count when no key can
    exceed the threshold; so does a right side that the planner broadcasts by its
    bytes."""
    spark = left.sparkSession
    if hot_rows is None:
        hot_rows = int(spark.conf.get(HOT_ROWS_CONF, str(DEFAULT_HOT_ROWS)))
    if left_rows is not None and left_rows <= hot_rows or planner_broadcasts(right):
        return left.join(right, keys, how)
    left = materialize(left, "lookup")
    total = left.count()
    if total <= hot_rows:
        return left.join(right, keys, how)
    limit = max(hot_rows, -(-total // MAX_HOT_KEYS))
    has_key = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    keyed = left.filter(has_key)
    hot = materialize(keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
                      .select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias("_parts")), "hot")
    if hot.isEmpty():
        joined = keyed.join(right, keys, how)
    else:
        few = F.broadcast(hot)      # at most MAX_HOT_KEYS keys
        parts = F.coalesce("_parts", F.lit(1))
        dealt = (keyed.join(few, keys, "left")
                 .withColumn("_salt", F.pmod(F.monotonically_increasing_id(), parts).cast("int")).drop("_parts"))
        copies = (right.join(few, keys, "left")
                  .withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts"))
        joined = dealt.join(copies, [*keys, "_salt"], how).drop("_salt")
    if how in ("inner", "left_semi"):
        return joined
    return joined.unionByName(left.filter(~has_key), allowMissingColumns=True)
