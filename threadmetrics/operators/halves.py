"""Dynamic analysis: sampling TLCs, time halves and per-half metrics.

F6, F7, W1-W3, A3, A6, A7, J1, J2, P10.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import EVEN_SAMPLE_MIN_STRATUM, EVEN_SAMPLE_PER_STRATUM
from ..functions.text import link_count
from .grouprank import group_rank
from .lineage import release
from .tree import _checkpoint, annotate, tree_stats

HALF_METRICS = ["Replies_links_count", "Replies_total_number", "Top_comment_direct_children",
                "Replies_sum_score", "Replies_max_depth"]


REPLY_COLUMNS = ["post_id", "comment_id", "parent_id", "subreddit", "subreddit_id", "score", "created_utc", "body"]


def replies_with_heights(comments: DataFrame, columns: list = REPLY_COLUMNS) -> DataFrame:
    """Every reply (``columns`` of it) with its TLC, level and height in the whole tree.

    Heights are taken before any split (the reference injects them into the
    whole tree first), so a half reports heights of the whole thread.
    Replies under a missing parent (orphans, see :func:`tree.orphans`) belong
    to no TLC and are left out here and in every per-TLC table. Materialised:
    the half split reads it several times.
    """
    found = tree_stats(comments)
    stats = found.select("post_id", "comment_id", "tlc_id", "level", "height")
    r = _checkpoint(comments.select(*columns).join(stats.filter((F.col("level") > 0) & F.col("tlc_id").isNotNull()),
                                                   ["post_id", "comment_id"], "inner"))
    release(found)
    return r


def reply_counts_by_key(comments: DataFrame) -> DataFrame:
    """A2 + A3: replies per TLC keyed by (subreddit, subreddit_id, id)."""
    ann = annotate(comments)
    tlc = comments.filter(F.col("parent_id").isNull()).select(
        "post_id", F.col("comment_id").alias("tlc_id"), "subreddit", "subreddit_id")
    cnt = (ann.filter(F.col("level") > 0).groupBy("post_id", "tlc_id")
           .agg(F.count(F.lit(1)).alias("_n")))
    per_tlc = tlc.join(cnt, ["post_id", "tlc_id"], "left")
    return (per_tlc.groupBy(F.col("subreddit").alias("Top_comment_subreddit"),
                            F.col("subreddit_id").alias("Top_comment_subreddit_id"),
                            F.col("tlc_id").alias("Top_comment_id"))
            .agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("n_replies")))


def even_tlcs(counts: DataFrame) -> DataFrame:
    """TLCs with a positive, even number of replies."""
    n = F.col("n_replies")
    return counts.filter((n > 0) & (n % 2 == 0))


def strata_sizes(even: DataFrame) -> DataFrame:
    """strata (subreddit, subreddit_id, n_replies) with at least 50 members."""
    return (even.groupBy("Top_comment_subreddit", "Top_comment_subreddit_id", "n_replies")
            .agg(F.count(F.lit(1)).alias("n_members"))
            .filter(F.col("n_members") >= EVEN_SAMPLE_MIN_STRATUM))


def sample_key(seed: int, id_col: str = "Top_comment_id"):
    """Reproducible pseudo-random order: md5 of ``seed:id`` (same text in
    Spark and DuckDB), ties by id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col)))


def stratified_sample(even: DataFrame, seed: int = 42, k: int = EVEN_SAMPLE_PER_STRATUM) -> DataFrame:
    """Per stratum with at least 50 members keep all if <= k, else k
    members drawn without replacement in md5 order.

    ``row_number() <= k`` is planned as a per-task group limit before the
    shuffle, so a hot stratum ships at most ``k`` rows per task; stratum sizes
    come from a partially aggregated count. Nothing per stratum is collected.
    """
    strata = ["Top_comment_subreddit", "Top_comment_subreddit_id", "n_replies"]
    w = Window.partitionBy(*strata).orderBy(sample_key(seed), F.col("Top_comment_id"))
    top = even.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")
    return top.join(strata_sizes(even).select(*strata), strata, "left_semi")


def stratified_sample_with_replacement(even: DataFrame, seed: int = 42, k: int = EVEN_SAMPLE_PER_STRATUM) -> DataFrame:
    """W3 as the reference draws it: strata with more than ``k`` members give
    ``k`` independent draws (a member may come more than once), smaller ones
    keep all. Members are numbered in md5 order across the cluster, and draw j
    of a stratum takes the member at position md5(seed, stratum, j) modulo its
    size: a join of ``k`` rows per stratum, never a collected stratum."""
    strata = ["Top_comment_subreddit", "Top_comment_subreddit_id", "n_replies"]
    sizes = strata_sizes(even)
    ranked = group_rank(even.withColumn("_h", sample_key(seed)), strata, ["_h", "Top_comment_id"], rank_col="_at",
                        size_col="_size").drop("_h", "_size")
    name = F.concat_ws(":", F.lit(str(seed)), *strata, F.col("_draw"))
    hexd = F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("bigint")
    draws = (sizes.withColumn("_draw", F.explode(F.sequence(F.lit(1), F.least(F.col("n_members"), F.lit(k)).cast("int"))))
             .withColumn("_at", F.when(F.col("n_members") <= k, F.col("_draw").cast("bigint"))
                         .otherwise(hexd % F.col("n_members") + 1)).drop("n_members"))
    return draws.join(ranked, [*strata, "_at"]).select(*even.columns, F.col("_draw").cast("bigint").alias("draw"))


def time_halves(replies: DataFrame) -> DataFrame:
    """W1 + W2: order the replies of each TLC by (created_utc, comment_id)
    and cut them into two equal halves; ``half`` is 0 or 1. Only TLCs with a
    positive even number of replies are split (F6 guard)."""
    ranked = group_rank(replies, ["post_id", "tlc_id"], ["created_utc", "comment_id"],
                        rank_col="time_rank", size_col="n_replies")
    n = F.col("n_replies")
    return (ranked.filter((n > 0) & (n % 2 == 0))
            .withColumn("half", F.when(F.col("time_rank") <= n / 2, 0).otherwise(1)))


def half_aggregates(tlc, links=None, direct=None) -> list:
    """Links, replies, direct replies, score sum (NULL adds 0), largest height."""
    return [F.sum(link_count(F.col("body")) if links is None else links).cast("bigint").alias("Replies_links_count"),
            F.count(F.lit(1)).cast("bigint").alias("Replies_total_number"),
            F.count_if(F.col("parent_id") == tlc if direct is None else direct).cast("bigint").alias("Top_comment_direct_children"),
            F.sum(F.coalesce("score", F.lit(0))).cast("bigint").alias("Replies_sum_score"),
            F.max("height").cast("bigint").alias("Replies_max_depth")]


def half_features(halves: DataFrame) -> DataFrame:
    """Per (TLC, half): links, replies, direct replies within the half,
    score sum (NULL adds 0) and the largest whole-tree height."""
    return halves.groupBy(F.col("tlc_id").alias("Top_comment_id"), "half").agg(*half_aggregates(F.col("tlc_id")))


def direct_total(halves: DataFrame) -> DataFrame:
    """Direct replies of each split TLC over both halves."""
    return (halves.groupBy(F.col("tlc_id").alias("Top_comment_id"))
            .agg(F.count_if(F.col("parent_id") == F.col("tlc_id")).cast("bigint")
                 .alias("Top_comment_direct_children")))


def fixed_half_features(halves: DataFrame) -> DataFrame:
    """Per-half metrics where the second half reports the direct replies
    of both halves (joined on the plain TLC id)."""
    hf = half_features(halves)
    tot = direct_total(halves).withColumnRenamed("Top_comment_direct_children", "_total")
    return (hf.join(tot, "Top_comment_id", "inner")
            .withColumn("Top_comment_direct_children",
                        F.when(F.col("half") == 1, F.col("_total"))
                        .otherwise(F.col("Top_comment_direct_children")))
            .drop("_total"))


def sample_join(sample: DataFrame, full: DataFrame) -> DataFrame:
    """Sampled ids joined to the full feature table (inner, on the id).

    The sample is at most k rows per stratum; AQE turns this into a
    broadcast join at run time when the measured sample is small."""
    return sample.select("Top_comment_id", "n_replies").join(full, "Top_comment_id", "inner")
