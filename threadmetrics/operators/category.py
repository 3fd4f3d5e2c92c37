"""Category dictionary and category vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import EMBEDDING_BLEND_ALPHA, GENERIC_CATEGORY_ID
from .indexing import global_index
from .skew import lookup_join

GENERIC_NAME = "<generic>"


def category_ids(names: DataFrame, name_col: str) -> DataFrame:
    """Distinct names sorted, ids 1..n; the generic entry has id 0."""
    d = names.select(F.col(name_col).alias("name")).where(F.col("name").isNotNull()).distinct()
    ids = global_index(d, ["name"], "category_id", start=1)
    generic = names.sparkSession.createDataFrame([(GENERIC_NAME, GENERIC_CATEGORY_ID)], "name string, category_id long")
    return ids.unionByName(generic)


def id_check(dictionary: DataFrame) -> DataFrame:
    """Ids must be exactly 0..n-1; one row with the facts and a verdict."""
    a = dictionary.agg(F.min("category_id").alias("min_id"), F.max("category_id").alias("max_id"),
                       F.count(F.lit(1)).alias("n"), F.count_distinct("category_id").alias("n_distinct"))
    ok = (F.col("min_id") == 0) & (F.col("max_id") == F.col("n") - 1) & (F.col("n_distinct") == F.col("n"))
    return a.select("min_id", "max_id", F.col("n").cast("bigint"), F.col("n_distinct").cast("bigint"),
                    ok.alias("ids_contiguous"))


def lookup(df: DataFrame, name_col: str, dictionary: DataFrame, out_col: str = "category_id") -> DataFrame:
    """Name -> id, unknown names (and NULL) -> the generic id 0. One
    popular category may cover many rows, so the lookup splits hot names;
    whether the dictionary is broadcast is the planner's decision by its bytes."""
    d = dictionary.select(F.col("name").alias("_name"), F.col("category_id").alias("_cid"))
    left = df.withColumn("_name", F.col(name_col))
    return (lookup_join(left, d, ["_name"]).drop("_name")
            .withColumn(out_col, F.coalesce("_cid", F.lit(GENERIC_CATEGORY_ID)).cast("bigint")).drop("_cid"))


def _uniform(key: Column, part: int) -> Column:
    """A uniform in (0, 1] from 8 hex digits of md5(key) (part 0..3)."""
    hexd = F.substring(F.md5(key), 1 + 8 * part, 8)
    return (F.conv(hexd, 16, 10).cast("double") + 1.0) / 4294967296.0


def hash_normal(key: Column) -> Column:
    """Standard normal by Box-Muller from two md5-derived uniforms."""
    return F.sqrt(-2.0 * F.log(_uniform(key, 0))) * F.cos(2.0 * math.pi * _uniform(key, 1))


def category_vectors(dictionary: DataFrame, vectors: DataFrame, vec_id: str, vec_col: str,
                     dim: int, mean: float, std: float, seed: int = 42) -> DataFrame:
    """For every category id the known vector (left join on the id), else
    a deterministic normal draw with the given mean and std, per cell.
    Output long form ``(category_id, j, value)``: cells stay rows."""
    known = (vectors.select(F.col(vec_id).alias("category_id"), F.posexplode(vec_col).alias("j", "_v"))
             .withColumn("j", F.col("j").cast("bigint")))
    cells = dictionary.select("category_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(dim - 1).cast("bigint"))).alias("j"))
    key = F.concat(F.lit(f"{seed}:"), F.col("category_id").cast("string"), F.lit(":"), F.col("j").cast("string"))
    return (cells.join(known, ["category_id", "j"], "left")
            .select("category_id", "j",
                    F.coalesce(F.col("_v").cast("double"), hash_normal(key) * std + mean).alias("value")))


def blend_with_generic(cells: DataFrame, alpha: float = EMBEDDING_BLEND_ALPHA) -> DataFrame:
    """``alpha * e[id] + (1 - alpha) * e[0]`` cell by cell (the generic
    vector is ``dim`` rows: broadcast)."""
    g = cells.filter(F.col("category_id") == GENERIC_CATEGORY_ID).select("j", F.col("value").alias("_g"))
    return (cells.join(F.broadcast(g), "j")
            .select("category_id", "j", (alpha * F.col("value") + (1 - alpha) * F.col("_g")).alias("value")))
