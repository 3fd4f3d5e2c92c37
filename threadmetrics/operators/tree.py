"""Reply trees on flat adjacency tables.

A reply tree arrives as rows ``(post_id, comment_id, parent_id)`` with
``parent_id`` NULL for a top-level comment (TLC). Recursion is replaced by
logarithmic-round joins:

* :func:`annotate` -- root (``tlc_id``) and ``level`` of every comment by
  pointer jumping: ``ceil(log2(depth)) + 1`` rounds.
* :func:`subtree_stats` -- height, subtree size and subtree sums of every
  comment by doubling with aggregation, same number of rounds.

Every join is keyed by ``(post_id, node)``, never by ``post_id`` alone, so a
giant thread spreads over all tasks. Many children of one parent meet in an
aggregation (map-side partial aggregation bounds it) or in a many-to-one
join, which AQE's skew-join handling splits. Each round ends by
writing its state below the shared checkpoint folder (:mod:`.lineage`), so
the plan does not grow and a lost executor costs one round, not the whole
lineage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import materialize, release, same_table
from .skew import largest_group, lookup_join

MAX_ROUNDS = 64  # 2**63 levels: never reached; guards against cycles


def _checkpoint(df: DataFrame) -> DataFrame:
    return materialize(df, "tree")


def annotate(comments: DataFrame) -> DataFrame:
    """Root and level of every comment.

    Returns ``(post_id, comment_id, tlc_id, level)``: ``level`` 0 for a TLC,
    1 for a direct reply. A comment whose chain reaches a missing parent gets
    ``tlc_id`` NULL (an orphan); it is kept, not dropped.
    """
    base = comments.select("post_id", "comment_id", "parent_id")
    # ptr: current ancestor pointer; dist: distance to it; done: ptr is the root
    state = base.select(
        "post_id",
        F.col("comment_id").alias("node"),
        F.coalesce("parent_id", "comment_id").alias("ptr"),
        F.when(F.col("parent_id").isNull(), 0).otherwise(1).alias("dist"),
        F.col("parent_id").isNull().alias("done"),
    )
    largest = largest_group(base, "post_id")
    for _ in range(MAX_ROUNDS):
        n_active = state.filter(~F.col("done")).count()
        if n_active == 0:
            break
        look = state.select(
            "post_id",
            F.col("node").alias("ptr"),
            F.col("ptr").alias("_ptr"),
            F.col("dist").alias("_dist"),
            F.col("done").alias("_done"),
        )
        active = lookup_join(state.filter(~F.col("done")), look, ["post_id", "ptr"], left_rows=min(n_active, largest))
        orphan = F.col("_ptr").isNull()
        stepped = active.select(
            "post_id",
            "node",
            F.when(orphan, F.lit(None).cast("string")).otherwise(F.col("_ptr")).alias("ptr"),
            (F.col("dist") + F.coalesce("_dist", F.lit(0))).alias("dist"),
            (orphan | F.col("_done")).alias("done"),
        )
        before, state = state, _checkpoint(state.filter(F.col("done")).unionByName(stepped))
        release(before)
    else:
        raise RuntimeError("reply tree has a cycle or is deeper than 2**64")
    return same_table(state.select(
        "post_id",
        F.col("node").alias("comment_id"),
        F.col("ptr").alias("tlc_id"),
        F.col("dist").cast("int").alias("level"),
    ), state)


def orphans(comments: DataFrame) -> DataFrame:
    """Comments whose chain of parents reaches one that is not there, with
    nothing else known of their thread: they count in no per-TLC table, and
    this is where they are seen."""
    return annotate(comments).filter(F.col("tlc_id").isNull()).select("post_id", "comment_id")


def comment_tree(comments: DataFrame) -> DataFrame:
    """``comments`` plus ``tlc_id`` and ``level`` (one 1:1 join)."""
    return comments.join(annotate(comments), ["post_id", "comment_id"], "inner")


def subtree_stats(comments: DataFrame, sums: dict[str, Column] | None = None) -> DataFrame:
    """Height, subtree size and subtree sums of every comment.

    ``height`` is 1 for a leaf and ``1 + max(height of children)`` otherwise;
    ``size`` counts the comment and all comments below it; every entry of
    ``sums`` (name -> per-comment value) is summed over the same subtree.

    Doubling: ``anc`` starts as the parent and ``step`` as 1. In a round each
    comment ``a`` that is the ``anc`` of some ``u`` takes
    ``h[a] = max(h[a], h[u] + step)`` and ``s[a] += s[u]`` (old values), then
    ``anc[u] = anc[anc[u]]`` and ``step *= 2``. After round k, ``h``/``s``
    cover all descendants closer than ``2**k``; stop when no ``anc`` is left.
    """
    sums = sums or {}
    names = list(sums)
    state = comments.select(
        "post_id",
        F.col("comment_id").alias("node"),
        F.col("parent_id").alias("anc"),
        F.lit(1).alias("height"),
        F.lit(1).cast("bigint").alias("size"),
        *[F.coalesce(c, F.lit(0)).alias(n) for n, c in sums.items()],
    )
    step = 1
    n_rows = None
    for _ in range(MAX_ROUNDS):
        if state.filter(F.col("anc").isNotNull()).isEmpty():
            break
        n_rows = n_rows if n_rows is not None else largest_group(state, "post_id")
        up = (state.filter(F.col("anc").isNotNull())
              .groupBy("post_id", F.col("anc").alias("node"))
              .agg(F.max("height").alias("_h"), F.sum("size").alias("_size"),
                   *[F.sum(n).alias("_" + n) for n in names]))
        jump = state.select("post_id", F.col("node").alias("anc"), F.col("anc").alias("_anc"))
        nxt = (lookup_join(state.join(up, ["post_id", "node"], "left"), jump, ["post_id", "anc"], left_rows=n_rows)
               .select(
                   "post_id", "node",
                   F.col("_anc").alias("anc"),
                   F.greatest("height", F.coalesce(F.col("_h") + step, F.lit(0))).alias("height"),
                   (F.col("size") + F.coalesce("_size", F.lit(0))).alias("size"),
                   *[(F.col(n) + F.coalesce("_" + n, F.lit(0))).alias(n) for n in names]))
        before, state = state, _checkpoint(nxt)
        release(before)
        step *= 2
    else:
        raise RuntimeError("reply tree has a cycle or is deeper than 2**64")
    return state.select("post_id", F.col("node").alias("comment_id"), "height", "size", *names)


# ----------------------------------------------------------------- roll-ups
def reply_rollup(comments: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """A1: per TLC, over all replies below it (the TLC itself not counted):
    ``Replies_total_number``, ``Replies_max_depth`` (direct reply = 1),
    ``Replies_links_count``, ``Replies_sum_score`` (NULL/0 scores add 0).
    A TLC without replies gives 0, 0, 0, 0. Also A8
    ``Top_comment_direct_children``.

    Needs ``body`` and ``score``; links are counted once per comment.
    """
    from ..functions.text import link_count

    tree = tree if tree is not None else comment_tree(comments)
    replies = (tree.filter(F.col("level") > 0)
               .groupBy("post_id", "tlc_id")
               .agg(F.count(F.lit(1)).alias("Replies_total_number"),
                    F.max("level").alias("Replies_max_depth"),
                    F.sum(link_count(F.col("body"))).alias("Replies_links_count"),
                    F.sum(F.coalesce("score", F.lit(0))).cast("bigint").alias("Replies_sum_score"),
                    F.count_if(F.col("level") == 1).alias("Top_comment_direct_children")))
    tlcs = comments.filter(F.col("parent_id").isNull()).select(
        "post_id", F.col("comment_id").alias("tlc_id"))
    cols = ["Replies_total_number", "Replies_max_depth", "Replies_links_count",
            "Replies_sum_score", "Top_comment_direct_children"]
    return (tlcs.join(replies, ["post_id", "tlc_id"], "left")
            .select(F.col("tlc_id").alias("Top_comment_id"),
                    *[F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")).alias(c) for c in cols]))


def reply_count(comments: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """A2: number of replies below each TLC (0 when none)."""
    r = reply_rollup(comments, tree)
    return r.select("Top_comment_id", F.col("Replies_total_number").alias("n_replies"))


def node_heights(comments: DataFrame) -> DataFrame:
    """A5: height of every comment (leaf = 1) and its subtree size, from the
    fused loop, where finished nodes take part in no join."""
    return tree_stats(comments).select("comment_id", "height", "size")


def direct_children(comments: DataFrame) -> DataFrame:
    """Number of direct children of every TLC (0 when none)."""
    tlcs = comments.filter(F.col("parent_id").isNull()).select("post_id", "comment_id")
    kids = (comments.filter(F.col("parent_id").isNotNull())
            .groupBy("post_id", F.col("parent_id").alias("comment_id"))
            .agg(F.count(F.lit(1)).alias("n")))
    return (tlcs.join(kids, ["post_id", "comment_id"], "left")
            .select(F.col("comment_id").alias("Top_comment_id"),
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("Top_comment_direct_children")))


def flatten_post_order(comments: DataFrame) -> DataFrame:
    """Every reply as a row with its TLC, level and height (the flat
    forest the half-split works on). The reference's post-order is only a
    tie-break; ordering is done explicitly downstream (W1)."""
    stats = tree_stats(comments).select("post_id", "comment_id", "tlc_id", "level", "height")
    return comments.join(stats, ["post_id", "comment_id"], "inner")


def tree_stats(comments: DataFrame, sums: dict[str, Column] | None = None) -> DataFrame:
    """Root, level, height, subtree size (and sums) of every comment in one
    loop: :func:`annotate` and :func:`subtree_stats` fused.

    Both walk the same pointers. At the start of round k a node that is not
    done points ``2**k`` levels up (``dist == 2**k``); a done node points at
    its root with ``dist`` = its level. So the doubling ancestor of round k
    is ``ptr`` exactly when ``dist == 2**k``; contributions go up along it
    (aggregation keyed by the ancestor) and unfinished nodes jump (join on
    ``ptr``). Stops when every node is done and no ancestor is left.
    """
    sums = sums or {}
    names = list(sums)
    state = comments.select(
        "post_id",
        F.col("comment_id").alias("node"),
        F.coalesce("parent_id", "comment_id").alias("ptr"),
        F.when(F.col("parent_id").isNull(), 0).otherwise(1).cast("bigint").alias("dist"),
        F.col("parent_id").isNull().alias("done"),
        F.lit(1).alias("height"),
        F.lit(1).cast("bigint").alias("size"),
        *[F.coalesce(c, F.lit(0)).alias(n) for n, c in sums.items()],
    )
    step, largest = 1, largest_group(comments, "post_id")
    for _ in range(MAX_ROUNDS):
        has_anc = (F.col("dist") == step) & F.col("ptr").isNotNull()
        n_active = state.filter(~F.col("done") | has_anc).count()
        if n_active == 0:
            break
        up = (state.filter(has_anc)
              .groupBy("post_id", F.col("ptr").alias("node"))
              .agg(F.max("height").alias("_h"), F.sum("size").alias("_size"),
                   *[F.sum(n).alias("_" + n) for n in names]))
        look = state.select("post_id", F.col("node").alias("ptr"), F.col("ptr").alias("_ptr"),
                            F.col("dist").alias("_dist"), F.col("done").alias("_done"))
        grown = state.join(up, ["post_id", "node"], "left").select(
            "post_id", "node", "ptr", "dist", "done",
            F.greatest("height", F.coalesce(F.col("_h") + step, F.lit(0))).alias("height"),
            (F.col("size") + F.coalesce("_size", F.lit(0))).alias("size"),
            *[(F.col(n) + F.coalesce("_" + n, F.lit(0))).alias(n) for n in names])
        # finished nodes keep their pointer; only the others jump
        jumped = lookup_join(grown.filter(~F.col("done")), look, ["post_id", "ptr"], left_rows=min(n_active, largest))
        orphan = F.col("_ptr").isNull()
        jumped = jumped.select(
            "post_id", "node",
            F.when(orphan, F.lit(None).cast("string")).otherwise(F.col("_ptr")).alias("ptr"),
            (F.col("dist") + F.coalesce("_dist", F.lit(0))).alias("dist"),
            (orphan | F.col("_done")).alias("done"),
            "height", "size", *names)
        before, state = state, _checkpoint(grown.filter(F.col("done")).unionByName(jumped))
        release(before)
        step *= 2
    else:
        raise RuntimeError("reply tree has a cycle or is deeper than 2**64")
    return same_table(state.select("post_id", F.col("node").alias("comment_id"), F.col("ptr").alias("tlc_id"),
                                   F.col("dist").cast("int").alias("level"), "height", "size", *names), state)
