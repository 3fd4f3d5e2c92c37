r"""Chat formatting of reply trees, as DataFrame and SQL functions only.

A reply tree is a table of nodes with parent ids. Root-to-leaf paths are
enumerated by iterative self-joins on node ids alone: the ancestor table is
joined with itself (1, 2, 4, ... steps up), and every leaf's path is extended
by that many ancestors per round, so a chain of a million turns takes twenty
rounds and each path entry is made once. The branches of a tree are ranked by
score across the cluster, and each chosen path is formatted as one conversation.

Template of a turn: ``### role:``, newline, text, newline, ``</turn>``,
newline. Inside roles and texts the control strings are escaped reversibly:
``\`` as ``\s``, ``###`` as ``\h``, ``</turn>`` as ``\t`` (in roles also
newline as ``\n`` and ``:`` as ``\c``). The loss mask is kept as segments: the
conversation is the concatenation of its segments, and the segments marked
``loss`` are the assistant texts.

Only ids, scores and lengths take part in numbering, paths and ranking; the
texts join the chosen paths at the end.

Defined results: null text and null role are empty; turns of one conversation
are in order of (turn, role, SHA-256 of the text), so ties and repeated rows
have one result; a null conversation id is a conversation of its own; an empty
table gives an empty result. One formatted conversation is one row: its size is
that of its own texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.indexing import global_index
from .common import materialize, with_uid

ASSISTANT = "assistant"
MAX_STEPS = 1 << 40         # no tree is deeper
# The template's fixed strings.
OPEN, NAMED, CLOSE = "### ", ":\n", "\n</turn>\n"


def _replace(col: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        col = F.replace(col, F.lit(a), F.lit(b))
    return col


TEXT_ESCAPES = [("\\", "\\s"), ("###", "\\h"), ("</turn>", "\\t")]
ROLE_ESCAPES = [*TEXT_ESCAPES, ("\n", "\\n"), (":", "\\c")]


def escape(text: Column) -> Column:
    return _replace(F.coalesce(text, F.lit("")), TEXT_ESCAPES)


def escape_role(role: Column) -> Column:
    return _replace(F.coalesce(role, F.lit("")), ROLE_ESCAPES)


def unescape(text: Column) -> Column:
    """Inverse of both: after escaping, every backslash introduces an escape."""
    return _replace(text, [(b, a) for a, b in reversed(ROLE_ESCAPES)])


# ------------------------------------------------------------ paths
def paths(nodes: DataFrame) -> DataFrame:
    """``leaf, node, up`` (steps from the leaf) for all root-to-leaf paths of
    ``nodes`` (``node``, unique, and ``parent``, null at roots)."""
    nodes = nodes.select("node", "parent")
    step = materialize(nodes.filter("parent is not null").select("node", F.col("parent").alias("anc")), "steps")
    leaves = nodes.join(step.select(F.col("anc").alias("node")).distinct(), "node", "left_anti")
    path = materialize(leaves.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "paths")
    dist = 1
    while not step.isEmpty():
        if dist > MAX_STEPS:
            raise ValueError("the parents of some node form a cycle")
        more = materialize(path.join(step, "node").select("leaf", F.col("anc").alias("node"),
                                                          (F.col("up") + dist).alias("up")), "paths")
        path = path.unionByName(more)
        step = materialize(step.join(step.select(F.col("node").alias("anc"), F.col("anc").alias("far")), "anc")
                           .select("node", F.col("far").alias("anc")), "steps")
        dist *= 2
    return path


def rank_branches(path: DataFrame, nodes: DataFrame) -> DataFrame:
    """``leaf, tree, score, branch_rank``: a branch's score is the mean of its
    nodes' scores; rank 1 is the best of its tree (ties by leaf)."""
    scored = (path.join(nodes.select("node", "score"), "node").groupBy("leaf").agg(F.avg("score").alias("score"))
              .join(nodes.select(F.col("node").alias("leaf"), "tree"), "leaf")
              .withColumn("_down", -F.col("score")))
    ranked = global_index(scored, ["tree", "_down", "leaf"], "_at")
    first = ranked.groupBy("tree").agg(F.min("_at").alias("_first"))
    return (ranked.join(first, ranked["tree"].eqNullSafe(first["tree"])).drop(first["tree"])
            .select("leaf", "tree", "score", (F.col("_at") - F.col("_first") + 1).alias("branch_rank")))


# ------------------------------------------------------------ formatting
def format_trees(nodes: DataFrame, texts: DataFrame | None = None, branches: int | None = None) -> DataFrame:
    """One row per chosen branch: ``tree, leaf, branch_rank, score, segments``.

    ``nodes``: tree, node (long, unique), parent (null at roots), score, and
    either role and text or the ``key`` of a row of ``texts`` (key, role,
    text). ``branches``: how many of each tree's best branches (all by
    default). ``segments``: array of (text, loss) whose concatenation is the
    formatted conversation."""
    if texts is None:
        texts = nodes.select(F.col("node").alias("key"), "role", "text")
        nodes = nodes.withColumn("key", F.col("node"))
    path = paths(nodes)
    chosen = rank_branches(path, nodes)
    if branches is not None:
        chosen = chosen.filter(F.col("branch_rank") <= branches)
    turns = texts.select("key", F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(NAMED)).alias("head"),
                         escape(F.col("text")).alias("body"),
                         F.coalesce(F.col("role") == ASSISTANT, F.lit(False)).alias("loss"))
    # the root comes first: it is the most steps up
    placed = path.join(chosen.select("leaf"), "leaf", "left_semi").join(nodes.select("node", "key"), "node")
    rows = placed.join(turns, "key").select("leaf", F.struct((-F.col("up")).alias("at"), "head", "body", "loss").alias("x"))

    def segments(x: Column) -> Column:
        return F.array(F.struct(x["head"].alias("text"), F.lit(False).alias("loss")),
                       F.struct(x["body"].alias("text"), x["loss"].alias("loss")),
                       F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss")))

    formatted = rows.groupBy("leaf").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return (chosen.join(formatted, "leaf")
            .select("tree", "leaf", "branch_rank", "score", F.flatten(F.transform("xs", segments)).alias("segments")))


def formatted(segments: Column) -> Column:
    """The conversation as one string."""
    return F.array_join(F.transform(segments, lambda x: x["text"]), "")


def read_turns(text: Column) -> Column:
    """Array of (role, text) parsed back from a formatted conversation."""
    parts = F.filter(F.split(text, CLOSE.replace("\n", "\\n")), lambda x: x != "")
    cut = lambda x: F.locate(NAMED, x)   # noqa: E731  roles hold neither ':' nor newline
    return F.transform(parts, lambda x: F.struct(
        unescape(F.substring(x, F.lit(len(OPEN) + 1), cut(x) - len(OPEN) - 1)).alias("role"),
        unescape(F.substring(x, cut(x) + len(NAMED), F.length(x))).alias("text")))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda x: x["loss"]), lambda x: unescape(x["text"])), "")


# ------------------------------------------------------------ conversations
def conversation_nodes(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
                       role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Linear conversations as reply trees (nodes, texts): each row replies to
    the one before."""
    texts = materialize(with_uid(conversations.select(
        F.col(id_col).alias("tree"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"),
        F.col(text_col).alias("text"))).withColumnRenamed("_uid", "key"), "turns")
    text = F.coalesce("text", F.lit(""))
    lite = texts.select("tree", "turn", "role", F.unhex(F.sha2(text, 256)).alias("digest"), "key",
                        F.length(text).cast("double").alias("score"))
    rows = global_index(lite, ["tree", "turn", "role", "digest", "key"], "node").select("tree", "node", "key", "score")
    rows = materialize(rows, "nodes")
    before = rows.select((F.col("node") + 1).alias("node"), F.col("tree").alias("_tree"), F.lit(True).alias("_any"))
    replies = F.col("_any") & F.col("tree").eqNullSafe(F.col("_tree"))
    nodes = rows.join(before, "node", "left").select("tree", "node", F.when(replies, F.col("node") - 1).alias("parent"),
                                                     "score", "key")
    return materialize(nodes, "tree"), texts.select("key", "role", "text")


def contract_table(branches: DataFrame) -> DataFrame:
    """Digest columns read back from the formatted conversations."""
    text = branches.withColumn("_f", formatted(F.col("segments")))
    read = text.withColumns({"_turns": read_turns(F.col("_f")), "_loss": loss_text(F.col("segments"))})
    said = F.array_join(F.transform("_turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(F.col("tree").alias("conv_id"), F.size("_turns").cast("long").alias("n_turns"),
                       F.sha2(said, 256).alias("turns_sha256"), F.length("_loss").cast("long").alias("loss_chars"),
                       F.sha2("_loss", 256).alias("loss_sha256"), F.length("_f").cast("long").alias("formatted_chars"),
                       F.col("branch_rank"))
