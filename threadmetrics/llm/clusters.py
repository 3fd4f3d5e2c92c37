"""Centroid clustering of integer vectors in JVM expressions.

Vectors are turned into integers once and stored; a round is then one scan:

* the distance to each centroid, a literal array, is ``zip_with`` and
  ``aggregate`` over whole numbers, so it does not depend on the order of
  additions;
* ``array_min`` over (distance, number) structs picks the nearest centroid,
  the smaller number on ties;
* one partially aggregated group-by sums every component per cluster: a task
  sends one row per centroid whatever it has read, and the driver gets
  ``k`` rows of sums.

Centroids stay ``k`` x ``dim`` numbers. A round that changes no centroid ends
the loop: all later rounds would repeat it.

Defined results: vectors with another number of components, a null or a
non-finite component (or null themselves) are left out; repeated vectors count
each; a null id counts as the text ``null``; with fewer than ``k`` vectors
there are as many centroids as vectors; an empty table gives no rows; extra
columns are ignored. Components beyond +-2**26 after scaling are refused with
an error: their squared distances would not fit a long.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

DIM, K, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
LARGEST = 1 << 26         # of a scaled component: 64 x (2 * 2**26) ** 2 is below 2**63


def integer_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = DIM,
                    scale: int = SCALE) -> DataFrame:
    """``id, v``: the kept vectors with each component as floor(scale * x)."""
    x = F.transform(F.col(f"`{vec_col}`"), lambda c: c.cast("double"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = table.select(F.col(f"`{id_col}`").alias("id"), x.alias("x")).filter((F.size("x") == dim) & finite)
    in_range = F.forall("x", lambda c: F.abs(c * scale) <= LARGEST)
    checked = F.when(in_range, F.transform("x", lambda c: F.floor(c * scale).cast("long"))).otherwise(
        F.raise_error(F.lit("a vector component is too large for whole-number distances")).cast("array<bigint>"))
    return kept.select("id", checked.alias("v"))


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    """The ``k`` vectors whose seeded id has the smallest SHA-256, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
    rows = vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()    # k rows
    return [list(r["v"]) for r in rows]


def distance(v: Column, centroid: list[int]) -> Column:
    """Squared Euclidean distance to a literal centroid."""
    there = F.lit(centroid).cast("array<bigint>")
    return F.aggregate(F.zip_with(v, there, lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, x: s + x)


def nearest(v: Column, centroids: list[list[int]]) -> Column:
    """``struct(distance, cluster)`` of the nearest centroid, the smaller number on ties."""
    return F.array_min(F.array(*[F.struct(distance(v, c).alias("distance"), F.lit(j).alias("cluster"))
                                 for j, c in enumerate(centroids)]))


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: floor of each cluster's mean, per component."""
    dim = len(centroids[0])
    assigned = vectors.select(nearest(F.col("v"), centroids)["cluster"].alias("cluster"),
                              *[F.col("v")[i].alias(f"v{i}") for i in range(dim)])
    sums = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"v{i}").alias(f"v{i}")
                                                                           for i in range(dim)])
    new = list(centroids)
    for r in sums.collect():          # at most k rows
        new[r["cluster"]] = [r[f"v{i}"] // r["n"] for i in range(dim)]
    return new


def fit(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> list[list[int]]:
    """Centroids after ``rounds`` rounds over all vectors."""
    centroids = first_centroids(vectors, k, seed)
    for _ in range(rounds if centroids else 0):
        new = moved(vectors, centroids)
        if new == centroids:
            break
        centroids = new
    return centroids


def cluster(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = DIM, k: int = K,
            rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """One row per kept vector: the id, ``cluster``, ``distance`` (squared),
    ``cluster_inertia``, ``inertia`` and ``centroid_sha256``."""
    vectors = materialize(integer_vectors(table, id_col, vec_col, dim, scale), "vectors")
    centroids = fit(vectors, k, rounds, seed)
    names = ("distance long, cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    if not centroids:
        return vectors.select(F.col("id").alias(id_col), *[
            F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in names.split(", "))]).select(
            id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    out = materialize(vectors.select("id", nearest(F.col("v"), centroids).alias("near")).select("id", "near.*"), "assigned")
    sums = {r["cluster"]: r["s"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows

    def per_cluster(values: list) -> Column:
        return F.element_at(F.lit(values), F.col("cluster") + 1)
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    inertia = [sums.get(j, 0) for j in range(len(centroids))]
    return out.select(F.col("id").alias(id_col), "cluster", "distance",
                      per_cluster(inertia).cast("long").alias("cluster_inertia"),
                      F.lit(sum(inertia)).cast("long").alias("inertia"), per_cluster(shas).alias("centroid_sha256"))
