"""Outcome metric tables per (TLC, half) that feed the merge.

The reference reads these as finished tables; the engine computes them
from the reply rows of :func:`halves.time_halves`. Marker lists are the
engine's own (``fixed.ACCOMMODATION_MARKERS``, ``PROSOCIAL_PATTERNS``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import (ACCOMMODATION_MARKERS, FUNDRAISING_HOSTS, INFORMATIVE_HOSTS,
                               PROSOCIAL_PATTERNS)
from . import halves as hv
from . import scores as sc
from .lineage import materialize, release, same_table
from .tree import annotate
from .skew import largest_group, lookup_join

KEY = ["Top_comment_id", "half"]
NEAR_ROWS = 100_000     # a larger thread is summed up before its rows move


def _words(body: Column) -> Column:
    return F.split(F.lower(F.coalesce(body, F.lit(""))), "[^a-z]+")


def has_marker(words: Column, category: str) -> Column:
    """Does a word array (see ``_words``) contain a marker of the category?"""
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in ACCOMMODATION_MARKERS[category]]))


# marker or link kind -> pattern
MARKS = {**{f"Replies_{k}_count": p for k, p in PROSOCIAL_PATTERNS.items()},
         "Replies_fundraising_URL_count": FUNDRAISING_HOSTS, "Replies_informative_URL_count": INFORMATIVE_HOSTS}
SCORES = ["politeness", "support", "toxicity", "attack"]


def with_scores(replies: DataFrame, scores: DataFrame) -> DataFrame:
    """Replies plus their scores (politeness and support 1..5, toxicity and
    attack 0..1) from a table keyed by (post_id, comment_id); a reply without
    scores keeps nulls."""
    return replies.join(scores.select("post_id", "comment_id", *SCORES), ["post_id", "comment_id"], "left")


def prosocial_aggregates(body: Column) -> list[Column]:
    """X3 + X4: how many bodies carry each marker or link kind."""
    return [F.count_if(body.rlike(p)).cast("bigint").alias(k) for k, p in MARKS.items()]


def score_aggregates() -> list[Column]:
    """Average rescaled (T14) politeness and support."""
    return [F.avg(sc.five_point_to_signed(F.col("politeness"))).alias("Replies_average_politeness"),
            F.avg(sc.five_point_to_signed(F.col("support"))).alias("Replies_average_support")]


def prosocial_counts(halves: DataFrame) -> DataFrame:
    """X3 + X4: replies per (TLC, half) that carry each marker or link kind."""
    body = F.coalesce(F.col("body"), F.lit(""))
    return halves.groupBy(F.col("tlc_id").alias("Top_comment_id"), "half").agg(*prosocial_aggregates(body))


def politeness_support(halves: DataFrame, scores: DataFrame) -> DataFrame:
    """X6 per half, from a scores table."""
    s = with_scores(halves, scores)
    return s.groupBy(F.col("tlc_id").alias("Top_comment_id"), "half").agg(*score_aggregates())


def toxicity(halves: DataFrame, scores: DataFrame) -> DataFrame:
    """X5 per half, from a scores table."""
    s = with_scores(halves, scores).withColumnRenamed("tlc_id", "Top_comment_id")
    return sc.toxic_children(s, F.col("toxicity"), F.col("attack"), KEY)


def marker_mask(words: Column) -> Column:
    """One bit per marker category: does the word array contain it?"""
    bits = [F.when(has_marker(words, m), 1 << i).otherwise(0) for i, m in enumerate(ACCOMMODATION_MARKERS)]
    return reduce(lambda a, b: a + b, bits)


def with_numbers(rows: DataFrame) -> DataFrame:
    """``rows`` with the numbers that the metrics take from ``body`` in its
    place: the links, one bit per marker or link kind, the marker mask. A text
    is then neither stored again nor moved."""
    body = F.coalesce(F.col("body"), F.lit(""))
    bits = reduce(lambda a, b: a + b, [F.when(body.rlike(p), 1 << i).otherwise(0) for i, p in enumerate(MARKS.values())])
    return with_masks(rows, "_cm").select("*", hv.link_count(F.col("body")).alias("_links"), bits.alias("_marks")).drop("body")


def with_masks(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` plus the marker mask of ``body`` (words are split once)."""
    return rows.withColumn("_words", _words(F.col("body"))).withColumn(name, marker_mask(F.col("_words"))).drop("_words")


def parent_masks(halves: DataFrame, comments: DataFrame, how: str) -> DataFrame:
    """Reply rows with their own marker mask ``_cm`` and their parent's
    ``_pm``: one many-to-one join on (post_id, parent_id) that carries a number
    of the parent, not its text."""
    par = with_masks(comments.select("post_id", F.col("comment_id").alias("parent_id"), "body"), "_pm").drop("body")
    rows = halves if "_cm" in halves.columns else with_masks(halves, "_cm")
    return lookup_join(rows, par, ["post_id", "parent_id"], how,
                       left_rows=largest_group(halves, "post_id"))


def accommodation_aggregates() -> list[Column]:
    """Counts behind X2 over rows with ``_cm`` and ``_pm``; rows without a
    parent do not count."""
    has = F.col("_pm").isNotNull()
    aggs = [F.count_if(has).alias("_n")]
    for i, m in enumerate(ACCOMMODATION_MARKERS):
        c, p = F.col("_cm").bitwiseAND(1 << i) != 0, F.col("_pm").bitwiseAND(1 << i) != 0
        aggs += [F.count_if(c & p).alias(f"_cp_{m}"), F.count_if(p).alias(f"_p_{m}"), F.count_if(c & has).alias(f"_c_{m}")]
    return aggs


def accommodation_columns() -> list[Column]:
    """X2 from the counts: P(reply has m | parent has m) - P(reply has m)."""
    outs = []
    for m in ACCOMMODATION_MARKERS:
        cond = F.col(f"_cp_{m}") / F.col(f"_p_{m}") - F.col(f"_c_{m}") / F.col("_n")
        outs.append(F.when(F.col(f"_p_{m}") > 0, cond).otherwise(F.lit(0.0)).alias(f"Top_comment_{m}_accommodation"))
    return outs


def accommodation(halves: DataFrame, comments: DataFrame) -> DataFrame:
    """Per (TLC, half) and marker category m over the half's replies and
    their parents: ``P(reply has m | parent has m) - P(reply has m)``; 0 when
    no parent has m."""
    j = parent_masks(halves.select("post_id", "parent_id", "tlc_id", "half", "body"), comments, "inner")
    a = j.groupBy(F.col("tlc_id").alias("Top_comment_id"), "half").agg(*accommodation_aggregates())
    return a.select(*KEY, *accommodation_columns())


def alternation(comments: DataFrame) -> DataFrame:
    """X7 building block: for every comment, the length ``alt`` of the
    longest run of two alternating authors ending at it along its ancestor
    path (A, B, A, ... ), and the author pair of that run.

    A comment continues its parent's run when its author differs from the
    parent's and equals the grandparent's. Cutting the tree at comments
    that do not continue a run turns runs into paths to a run start; the
    pointer-jumping :func:`tree.annotate` then gives the distance to it.
    """
    c = comments.select("post_id", "comment_id", "parent_id", "author")
    p = c.select("post_id", F.col("comment_id").alias("parent_id"), F.col("parent_id").alias("_gp"),
                 F.col("author").alias("_pa"))
    g = c.select("post_id", F.col("comment_id").alias("_gp"), F.col("author").alias("_ga"))
    n = largest_group(c, "post_id")
    x = lookup_join(lookup_join(c, p, ["post_id", "parent_id"], left_rows=n), g, ["post_id", "_gp"], left_rows=n)
    cont = (F.col("_pa").isNotNull() & (F.col("_pa") != F.col("author"))
            & F.col("_ga").isNotNull() & (F.col("_ga") == F.col("author")))
    base = F.when(F.col("_pa").isNull() | (F.col("_pa") == F.col("author")), 1).otherwise(2)
    x = materialize(x.select("post_id", "comment_id", "parent_id", "author", "_pa", cont.alias("cont"),
                             base.alias("base")), "alternation")
    cut = x.select("post_id", "comment_id", F.when(F.col("cont"), F.col("parent_id")).alias("parent_id"))
    found = annotate(cut)
    runs = found.select("post_id", "comment_id", F.col("tlc_id").alias("_start"), F.col("level").alias("_d"))
    starts = x.select("post_id", F.col("comment_id").alias("_start"), F.col("base").alias("_base"))
    # a whole run tree may hang on one start
    out = (lookup_join(x.join(runs, ["post_id", "comment_id"]), starts, ["post_id", "_start"], "inner", left_rows=n)
           .select("post_id", "comment_id", (F.col("_base") + F.col("_d")).alias("alt"),
                   F.least("author", "_pa").alias("pair_a"), F.greatest("author", "_pa").alias("pair_b"),
                   "cont"))
    out = materialize(out, "runs")
    release(x)
    release(found)
    return out


def sustained_aggregates() -> list[Column]:
    """X7 over rows of :func:`alternation`."""
    mx, cont = F.max("alt"), F.coalesce(F.col("cont"), F.lit(False))
    return [F.count_distinct(F.when(cont, F.col("pair_a")), F.when(cont, F.col("pair_b"))).cast("bigint")
            .alias("Replies_distinct_pairs_of_sustained_conversation"),
            F.when(mx >= 3, mx).otherwise(0).cast("bigint").alias("Replies_max_turns_of_sustained_conversations")]


def sustained(halves: DataFrame, comments: DataFrame) -> DataFrame:
    """Distinct author pairs with an A->B->A exchange ending in the half,
    and the longest alternating run ending in the half (0 below 3 turns)."""
    j = halves.select("post_id", "comment_id", "tlc_id", "half").join(alternation(comments), ["post_id", "comment_id"])
    return j.groupBy(F.col("tlc_id").alias("Top_comment_id"), "half").agg(*sustained_aggregates())


def all_outcomes(halves: DataFrame, comments: DataFrame, scores: DataFrame) -> DataFrame:
    """Every metric of the seven tables in one aggregation per (TLC, half):
    each reply row meets its parent's marker mask, its scores and its
    alternation once, and is grouped once. ``halves`` have a body or its numbers
    (:func:`with_numbers`); the joined rows are stored, so that the tables and
    shuffles behind them need not last as long as the result."""
    halves = with_numbers(halves) if "body" in halves.columns else halves
    rows = halves.select("post_id", "comment_id", "parent_id", "tlc_id", "half", "score", "height", "_cm", "_links", "_marks")
    rows = parent_masks(rows, comments, "left").withColumn("_direct", F.col("parent_id") == F.col("tlc_id")).drop("parent_id")
    runs = alternation(comments)
    rows = materialize(with_scores(rows, scores).join(runs, ["post_id", "comment_id"], "left").drop("comment_id"), "outcome-rows")
    release(runs)
    marks = [F.count_if(F.col("_marks").bitwiseAND(1 << i) != 0).cast("bigint").alias(k) for i, k in enumerate(MARKS)]
    rows = same_table(rows.withColumnRenamed("tlc_id", "Top_comment_id"), rows)
    # both halves of a thread of bounded size meet once, as rows narrower than their sums
    near = rows.repartition("post_id", "Top_comment_id") if largest_group(rows, "post_id") <= NEAR_ROWS else rows
    per = near.groupBy("post_id", "Top_comment_id", "half").agg(
        *hv.half_aggregates(F.col("Top_comment_id"), F.col("_links"), F.col("_direct")), *marks, *accommodation_aggregates(),
        *score_aggregates(), *sc.toxic_aggregates(F.col("toxicity"), F.col("attack")), *sustained_aggregates())
    both = Window.partitionBy("post_id", "Top_comment_id")      # two rows
    direct = F.col("Top_comment_direct_children")
    per = per.withColumn("Top_comment_direct_children", F.when(F.col("half") == 1, F.sum(direct).over(both)).otherwise(direct))
    keep = [c for c in per.columns if not c.startswith("_")]
    return same_table(per.select(*keep, *accommodation_columns()), rows)
