"""Scores, rescalings, flags, pairs and reproducible subsets.

A14-A18, T13-T16, M9, W4, W5, J7, P8, X5. Every metric is one aggregation
(partial + final); nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import TOXIC_THRESHOLD, TUNED_ATTACK_THRESHOLD, TUNED_TOXIC_THRESHOLD
from .lineage import materialize


def regression_scores(df: DataFrame, label: str, pred: str) -> DataFrame:
    """``r2 = 1 - SSE / SST`` and ``mse = SSE / n`` in one pass
    (SST = n * var_pop(y), merged stably across partitions)."""
    y, p = F.col(label).cast("double"), F.col(pred).cast("double")
    a = df.agg(F.count(F.lit(1)).alias("n"), F.sum((y - p) * (y - p)).alias("sse"),
               F.var_pop(y).alias("vy"))
    sst = F.col("vy") * F.col("n")
    return a.select(F.col("n").cast("bigint").alias("n"),
                    (1 - F.col("sse") / sst).alias("r2"),
                    (F.col("sse") / F.col("n")).alias("mse"))


def classification_scores(df: DataFrame, logits: list[str], gold: str) -> DataFrame:
    """Mean cross-entropy ``logsumexp(z) - z[gold]`` (stable form) and
    accuracy of ``argmax(z) = gold``."""
    zs = [F.col(c).cast("double") for c in logits]
    m = F.greatest(*zs)
    lse = m + F.log(sum((F.exp(z - m) for z in zs[1:]), F.exp(zs[0] - m)))
    zg = F.element_at(F.array(*zs), F.col(gold).cast("int") + 1)
    argmax = F.lit(0)
    best = zs[0]
    for i, z in enumerate(zs[1:], start=1):
        argmax = F.when(z > best, F.lit(i)).otherwise(argmax)
        best = F.greatest(best, z)
    return df.agg(F.avg(lse - zg).alias("cross_entropy"),
                  F.avg((argmax == F.col(gold)).cast("double")).alias("accuracy"),
                  F.count(F.lit(1)).cast("bigint").alias("n"))


def pair_scores(df: DataFrame, pred: str, gold: str) -> DataFrame:
    """Accuracy, recall of class 0 (left), of class 1 (right) and the
    harmonic mean of the two recalls; a recall of an absent class is NULL."""
    p, g = F.col(pred), F.col(gold)
    a = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(p == g).alias("hit"),
               F.count_if(g == 0).alias("g0"), F.count_if((g == 0) & (p == 0)).alias("h0"),
               F.count_if(g == 1).alias("g1"), F.count_if((g == 1) & (p == 1)).alias("h1"))
    rl = F.when(F.col("g0") > 0, F.col("h0") / F.col("g0"))
    rr = F.when(F.col("g1") > 0, F.col("h1") / F.col("g1"))
    out = a.select((F.col("hit") / F.col("n")).alias("accuracy"), rl.alias("recall_l"), rr.alias("recall_r"))
    s = F.col("recall_l") + F.col("recall_r")
    return out.withColumn("f1_score", F.when(s > 0, 2 * F.col("recall_l") * F.col("recall_r") / s))


def mean_baseline(df: DataFrame, label: str) -> DataFrame:
    """Predict the mean label for every row, scored by A14 (the mean is
    one scalar computed first)."""
    mean = df.agg(F.avg(F.col(label).cast("double"))).first()[0]
    return regression_scores(df.withColumn("_mean", F.lit(mean)), label, "_mean")


def cell_moments(df: DataFrame, vec: str) -> DataFrame:
    """Mean and population standard deviation of all vector cells."""
    cells = df.select(F.explode(vec).alias("x"))
    x = F.col("x").cast("double")
    return cells.agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"),
                     F.count(F.lit(1)).cast("bigint").alias("n_cells"))


# ------------------------------------------------------------- scalar rescalings
def unit_to_signed(p: Column) -> Column:
    """[0, 1] -> [-1, 1]."""
    return 2 * p - 1


def five_point_to_signed(x: Column) -> Column:
    """[1, 5] -> [-1, 1]."""
    return 0.5 * x - 1.5


def toxicity_flags(tox: Column, attack: Column) -> tuple[Column, Column]:
    """Untuned ``tox > 0.5``; tuned ``tox > 0.8 and attack > 0.5``."""
    untuned = F.when(tox > TOXIC_THRESHOLD, 1).otherwise(0)
    tuned = F.when((tox > TUNED_TOXIC_THRESHOLD) & (attack > TUNED_ATTACK_THRESHOLD), 1).otherwise(0)
    return untuned, tuned


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two equal-length numeric arrays."""
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")),
                           F.lit(0.0), lambda acc, t: acc + t)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


# ------------------------------------------------------------- pairs
def rank_pair(score_l: Column, score_r: Column, tie_key: Column) -> Column:
    """M9: 0 if the left score is higher, 1 if the right is, else a fixed
    pseudo-random bit (parity of the first md5 hex digit of ``tie_key``)."""
    bit = F.conv(F.substring(F.md5(tie_key), 1, 1), 16, 10).cast("int") % 2
    return (F.when(score_l > score_r, 0).when(score_l < score_r, 1).otherwise(bit)).cast("int")


def suffixed(df: DataFrame, key: str, suffix: str) -> DataFrame:
    """Every column renamed with ``_l``/``_r``."""
    return df.select(*[F.col(c).alias(f"{c}{suffix}") for c in df.columns])


def pair_features(pairs: DataFrame, features: DataFrame, key: str,
                  l_col: str = "l_id", r_col: str = "r_id") -> DataFrame:
    """Pair table joined twice to the feature table (equi joins on the
    id; one row per pair, features suffixed ``_l`` and ``_r``)."""
    left = suffixed(features, key, "_l")
    right = suffixed(features, key, "_r")
    return (pairs.join(left, pairs[l_col] == left[f"{key}_l"], "inner")
            .join(right, pairs[r_col] == right[f"{key}_r"], "inner")
            .drop(f"{key}_l", f"{key}_r"))


# ------------------------------------------------------------- subsets
def hash_order(seed: int, id_col: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def random_subset(df: DataFrame, id_col: str, k: int, seed: int = 42) -> DataFrame:
    """The ``k`` rows that come first in (md5, id) order, without a top-k
    in one task. A histogram of hash prefixes (at most 65,536 rows) finds the
    bucket that holds the k-th row; buckets below it are kept whole, and only
    the boundary bucket, about rows / 65,536, is put in order."""
    rows = materialize(df.withColumn("_h", hash_order(seed, id_col)), "subset")
    prefix = F.substring("_h", 1, 4)
    sizes = sorted((r["p"], r["n"]) for r in rows.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    below, edge = 0, None
    for p, n in sizes:
        if below + n > k:
            edge = p
            break
        below += n
    if edge is None:
        return rows.drop("_h")
    first = Window.partitionBy(prefix).orderBy("_h", id_col)
    part = (rows.filter(prefix == edge).withColumn("_r", F.row_number().over(first))
            .filter(F.col("_r") <= k - below).drop("_r"))
    return rows.filter(prefix < edge).unionByName(part).drop("_h")


def eval_subset_size(n: int, mode: str = "n/500") -> int:
    """The evaluation subset size ``n // 500`` or ``max(n // 1000, 2)``."""
    return n // 500 if mode == "n/500" else max(n // 1000, 2)


def toxic_children(replies: DataFrame, tox: Column, attack: Column, group_cols: list[str]) -> DataFrame:
    """Per group, toxic replies (untuned, tuned) and the share of
    non-toxic replies (untuned, tuned)."""
    return replies.groupBy(*group_cols).agg(*toxic_aggregates(tox, attack))


def toxic_aggregates(tox: Column, attack: Column) -> list[Column]:
    """X5's counts and shares; a reply without scores is not toxic."""
    u, t = toxicity_flags(tox, attack)
    return [F.sum(u).cast("bigint").alias("Replies_untuned_toxicity_children_count"),
            F.sum(t).cast("bigint").alias("Replies_tuned_toxicity_children_count"),
            F.avg(1 - u).alias("Replies_untuned_non_toxic_percentage"),
            F.avg(1 - t).alias("Replies_tuned_non_toxic_percentage")]
