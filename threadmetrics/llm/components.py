"""Connected components of an edge table by alternating star contractions.

Large-star and small-star rounds (Kiveris et al., 2014): each round is one
partially aggregated minimum per node and one join; the number of edges never
grows, every node ends up pointing at the smallest node of its component, and
the rounds needed grow with the logarithm of the data. Each round is written
to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v) rows plus ``m``, the smallest of u and its v's."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(low, "u")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    star = _star(down)
    own = star.select("u", F.col("m").alias("v"))
    rest = star.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.union(rest).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``u, v`` that is not its
    component's smallest node (roots and lone nodes have no row)."""
    state = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                        .distinct(), "edges")
    seen = None
    while True:
        mark = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        state = materialize(_small(_large(state)), "edges")
