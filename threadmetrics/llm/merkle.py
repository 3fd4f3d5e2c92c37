"""Merkle manifest of a table: roots and membership proofs by a nested-struct rollup.

Every row is a leaf, the SHA-256 of its columns. Per group the leaves ascend by
id; runs of ``fanout`` consecutive nodes become the hash of their digests until
one is left, the group's subroot; the subroots, ordered by group, likewise give
the root. In Spark:

1. Ranks: the leaves are range-partitioned by (group, id) and sorted, so a
   row's place in its partition plus the sizes of earlier partitions is its
   rank; no window spans a group.
2. Rollup: a rank is a block number and ``LEVELS`` digits in base ``fanout``.
   The rows of a block meet once (one exchange by group and block); then the
   digit columns are grouped away one after the other, each step nesting the
   child structs in their parent. A block holds at most ``fanout ** LEVELS``
   leaves, whatever the size of its group.
3. Block roots are the nodes of the next tier, and so on until every group has
   one block; its roots are the leaves of the tree over groups.
4. Proofs: coming down, each tier's steps are added to the blocks below
   (union and group on the block's key), and one nested ``transform`` over the
   block's structs with one ``explode`` gives every node its steps. Nothing
   joins leaves with nodes.

A step holds the digests of the run's other nodes, ``before`` and ``after``;
a node that is alone in its run has a step with neither. Folding a leaf
through its steps gives the root.

Defined results: any column may be null (hashed as ``-``); null ids come
first, null groups too; rows with equal id are ordered by leaf, equal rows are
leaves of their own; texts are hashed whole; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

FANOUT = 2
LEVELS = 10               # digits grouped away within a block: 1,024 leaves at fan-out 2
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the strings put together."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(col: Column) -> Column:
    """``-`` for null, else the value's UTF-8 length, a colon and the value."""
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*cols: Column) -> Column:
    """The leaf digest of a row with these columns."""
    return digest(*[field(c) for c in cols])


# ------------------------------------------------------------ ranks
def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` (_g, _o, h, item) as nodes: plus ``_r``, the rank within _g by
    (_o, h) from 0, and ``_n``, the number of rows of _g."""
    spread = materialize(rows.withColumn("_u", F.monotonically_increasing_id()), "merkle-leaves")
    order = ["_g", "_o", "h", "_u"]
    at = F.monotonically_increasing_id()      # partition number above bit 33, place in the sorted partition below
    placed = materialize(spread.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "_g", "h", "item", at.alias("_at")).withColumn("_p", F.shiftright("_at", 33)), "merkle-ranked")
    runs = placed.groupBy("_p", "_g").agg(F.count(F.lit(1)).alias("_c"), F.min("_at").alias("_first"))
    by = Window.partitionBy("_g")             # a group has a row per partition that holds it
    runs = runs.select(F.col("_p").alias("_p2"), F.col("_g").alias("_g2"), "_first", F.sum("_c").over(by).alias("_n"),
                       (F.sum("_c").over(by.orderBy("_p")) - F.col("_c")).alias("_off"))
    return placed.join(runs, (F.col("_p") == F.col("_p2")) & F.col("_g").eqNullSafe(F.col("_g2"))).select(
        "_g", "_n", (F.col("_at") - F.col("_first") + F.col("_off")).alias("_r"), "h", "item")


# ------------------------------------------------------------ rollup and proofs
def _count(n: Column, level: int, fanout: int) -> Column:
    """Nodes at a level of a tree with ``n`` leaves."""
    return F.ceil(n / F.lit(fanout ** level)) if level else n


def rollup(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """One row per block: ``_g, _n, _blk, node``, the node nesting its children."""
    size = fanout ** levels
    digits = [f"_d{k}" for k in range(levels)]
    state = nodes.select("_g", "_n", F.expr(f"_r div {size}").alias("_blk"),
                         *[F.expr(f"cast(_r div {fanout ** k} % {fanout} as int)").alias(d) for k, d in enumerate(digits)],
                         F.struct("h", "item").alias("node")).repartition("_g", "_blk")
    for k, d in enumerate(digits):
        kids = F.array_sort(F.collect_list(F.struct(d, "node")))
        state = state.groupBy("_g", "_n", "_blk", *digits[k + 1:]).agg(kids.alias("_kids"))
        children = F.transform("_kids", lambda x: x["node"])
        joined = F.array_join(F.transform("_kids", lambda x: x["node"]["h"]), "")
        # the last node left in its group is the top and is hashed no more
        h = F.when(_count(F.col("_n"), k, fanout) > 1, digest(joined)).otherwise(F.col("_kids")[0]["node"]["h"])
        state = state.select("_g", "_n", "_blk", *digits[k + 1:],
                             F.struct(h.alias("h"), children.alias("kids")).alias("node"))
    return state


def _proofs(node: Column, level: int, above: Column, n: Column, fanout: int) -> Column:
    """Array of (item, steps) of all nodes below ``node``."""
    if level == 0:
        return F.array(F.struct(node["item"].alias("item"), above.alias("steps")))

    def child(kid: Column, i: Column) -> Column:
        hs = F.transform(node["kids"], lambda x: x["h"])
        step = F.struct(F.array_join(F.slice(hs, F.lit(1), i), "").alias("before"),
                        F.array_join(F.slice(hs, i + 2, F.lit(fanout)), "").alias("after"))
        mine = F.when(_count(n, level - 1, fanout) > 1, F.array(step)).otherwise(F.lit(None).cast(STEPS))
        return _proofs(kid, level - 1, F.concat(F.coalesce(mine, F.array().cast(STEPS)), above), n, fanout)
    return F.flatten(F.transform(node["kids"], child))


def prove(nodes: DataFrame, finish: Callable[[DataFrame], DataFrame], fanout: int = FANOUT,
          levels: int = LEVELS) -> DataFrame:
    """``item, steps, top, root`` for every node of the trees ``nodes`` (_g,
    _n, _r, h, item). ``finish`` takes the trees' tops (_g, h) and returns
    ``_g, steps, top, root``: what follows above them."""
    blocks = materialize(rollup(nodes, fanout, levels), "merkle-blocks")
    many = blocks.agg(F.max("_blk")).first()[0]
    if not many:
        upper = finish(blocks.select("_g", F.col("node.h").alias("h"))).withColumn("_blk", F.lit(0).cast("long"))
    else:
        count = F.expr(f"(_n + {fanout ** levels - 1}) div {fanout ** levels}")
        upper = prove(blocks.select("_g", count.alias("_n"), F.col("_blk").alias("_r"), F.col("node.h").alias("h"),
                                    F.struct("_g", "_blk").alias("item")), finish, fanout, levels)
        upper = upper.select("item._g", "item._blk", "steps", "top", "root")
    # each block meets the steps above it: one row of either kind per key
    both = blocks.select("_g", "_n", "_blk", "node").unionByName(
        upper.select("_g", "_blk", "steps", "top", "root"), allowMissingColumns=True)
    met = both.groupBy("_g", "_blk").agg(*[F.first(c, ignorenulls=True).alias(c)
                                           for c in ("_n", "node", "steps", "top", "root")])
    return met.select(F.explode(_proofs(F.col("node"), levels, F.col("steps"), F.col("_n"), fanout)).alias("p"),
                      "top", "root").select("p.item", "p.steps", "top", "root")


def _forest_root(fanout: int, levels: int) -> Callable[[DataFrame], DataFrame]:
    """The tree over the groups' subroots, as the ``finish`` of the groups' trees."""
    def top(tops: DataFrame) -> DataFrame:
        return tops.select("_g", F.array().cast(STEPS).alias("steps"), F.col("h").alias("top"), F.col("h").alias("root"))

    def finish(tops: DataFrame) -> DataFrame:
        leaves = tops.select(F.lit(0).alias("_g"), F.col("_g").alias("_o"), "h", F.struct("_g", "h").alias("item"))
        got = prove(ranked(leaves), top, fanout, levels)
        return got.select("item._g", "steps", F.col("item.h").alias("top"), "root")
    return finish


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", group_col: str = "lang",
             fanout: int = FANOUT, levels: int = LEVELS, **carry: Column) -> DataFrame:
    """One row per row of ``docs``: the id, the group, ``leaf``, ``steps`` (its
    proof), ``subroot``, ``root`` and the ``carry`` columns, which take no part
    in the tree."""
    leaf = leaf_of(*[F.col(f"`{c}`") for c in columns])
    item = F.struct(F.col(f"`{id_col}`").alias("id"), F.col(f"`{group_col}`").alias("group"), leaf.alias("leaf"),
                    *[c.alias(name) for name, c in carry.items()])
    rows = docs.select(F.col(f"`{group_col}`").alias("_g"), F.col(f"`{id_col}`").alias("_o"), item.alias("item"))
    rows = rows.select("_g", "_o", F.col("item.leaf").alias("h"), "item")
    got = prove(ranked(rows), _forest_root(fanout, levels), fanout, levels)
    return got.select(F.col("item.id").alias(id_col), F.col("item.group").alias(group_col), "item.leaf",
                      *[f"item.{name}" for name in carry], "steps", F.col("top").alias("subroot"), "root")


def fold(leaf: Column, steps: Column) -> Column:
    """The root that ``leaf`` gives through the steps of a proof."""
    return F.aggregate(steps, leaf, lambda acc, s: digest(s["before"], acc, s["after"]))


def proof_digest(steps: Column) -> Column:
    """SHA-256 of a proof's digests, level by level, left to right."""
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""))


def audit(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` and a tamper test: where 7 divides the CRC-32
    of the id, one is added to ``n_chars`` (nulls stay) after the manifest was
    made, and the leaf is folded again through its original proof."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    n_chars = F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    now = F.when(tampered, leaf_of(*[n_chars if c == "n_chars" else F.col(c) for c in COLUMNS]))
    rows = manifest(docs, now=now)
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"),
                       fold(F.coalesce("now", "leaf"), F.col("steps")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))
