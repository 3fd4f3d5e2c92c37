"""Quality classifier: a sparse rule ensemble compiled into column expressions.

1. Statistics of the whole text (``FEATURES``) are plain column expressions.
2. A small forest is grown on the labelled rows; every path from a root to a
   node becomes one conjunctive rule over the statistics.
3. A lasso logistic regression over the 0/1 rules keeps a few of them.
4. The kept rules and weights are compiled into one column expression, so
   scoring is a single pass over the texts without a join or a shuffle.

Labels are learned from at most ``MAX_LABELLED`` labelled rows (the lowest
hashes of their ids, a documented bound of the fit); scoring covers every row.

Defined results: null text counts as empty, and empty texts are scored like
others (their statistics are zero); rows with a null label are not learned
from; repeated rows are scored alike; without rows of both labels the score is
the smoothed share of label 1 and nothing is rejected (there is no classifier);
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, packed, unpack

MAX_LABELLED = 20_000
HELD_OUT = 2                # rows whose id hashes to this remainder are never learned from
TREES, DEPTH = 20, 3
LASSO = 0.002
ACCEPT = 0.7
FEATURES = ("words", "mean_word", "longest_word", "distinct_words", "repeated_next", "symbols", "bangs", "upper",
            "digits", "stops", "repeated_lines")

Rule = tuple[tuple[str, bool, float], ...]      # (statistic, at most?, threshold), all of them


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == HELD_OUT, F.lit(False))


def with_statistics(df: DataFrame, text: Column) -> DataFrame:
    """``df`` plus one double column ``f_<name>`` for each statistic."""
    df = df.withColumn("_t", F.coalesce(text, F.lit("")))
    df = df.withColumns({"_w": F.filter(F.split("_t", r"[\x20\x09-\x0D]+"), lambda w: w != ""),
                         "_l": F.split("_t", "\n")})
    n = F.greatest(F.length("_t"), F.lit(1))
    w = F.greatest(F.size("_w"), F.lit(1))

    def share(pattern: str) -> Column:
        return F.regexp_count("_t", F.lit(pattern)) / n

    nexts = F.zip_with("_w", F.slice("_w", F.lit(2), F.greatest(F.size("_w"), F.lit(1))), lambda a, b: a == b)
    stats = {
        "words": F.log1p(F.size("_w")),
        "mean_word": F.aggregate("_w", F.lit(0), lambda a, x: a + F.length(x)) / w,
        "longest_word": F.log1p(F.coalesce(F.array_max(F.transform("_w", F.length)), F.lit(0))),
        "distinct_words": F.size(F.array_distinct("_w")) / w,
        "repeated_next": F.size(F.filter(nexts, lambda x: x)) / w,
        "symbols": share(r"[#*$%&|<>]"),
        "bangs": share("!"),
        "upper": share(r"\p{Lu}"),
        "digits": share("[0-9]"),
        "stops": share("[.]"),
        "repeated_lines": (F.size("_l") - F.size(F.array_distinct("_l"))) / F.size("_l"),
    }
    return df.withColumns({f"f_{k}": v.cast("double") for k, v in stats.items()}).drop("_t", "_w", "_l")


# ------------------------------------------------------------ fitting
def _paths(node, path: Rule, names: tuple[str, ...]) -> list[Rule]:
    """Every path from the root to a node below it."""
    rules = [path] if path else []
    if node.subtreeDepth() > 0:
        name, cut = names[node.split().featureIndex()], float(node.split().threshold())
        for child, at_most in ((node.leftChild(), True), (node.rightChild(), False)):
            rules += _paths(child, (*path, (name, at_most, cut)), names)
    return rules


def rule_column(rule: Rule) -> Column:
    tests = [F.col(f"f_{name}") <= cut if at_most else F.col(f"f_{name}") > cut for name, at_most, cut in rule]
    return F.when(reduce(lambda a, b: a & b, tests), 1.0).otherwise(0.0)


class RuleEnsemble:
    """Intercept and weighted rules; ``score`` is a column over the ``f_``
    statistics."""

    def __init__(self, intercept: float, rules: list[tuple[float, Rule]]):
        self.intercept, self.rules = intercept, rules

    def score(self) -> Column:
        total = reduce(lambda a, b: a + b, [F.lit(w) * rule_column(r) for w, r in self.rules], F.lit(self.intercept))
        return 1 / (1 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> RuleEnsemble:
    """Rules and weights from the labelled rows that are not held out."""
    ids = F.col(id_col)
    chosen = (labels.filter(F.col(label_col).isin(0, 1) & ids.isNotNull() & ~held_out(ids))
              .select(ids.alias("_id"), F.col(label_col).cast("double").alias("label"))
              .orderBy(F.xxhash64("_id"), "_id", "label").limit(max_labelled))
    rows = (docs.select(ids.alias("_id"), F.col(text_col).alias("_text"))
            .join(F.broadcast(chosen), "_id"))       # at most max_labelled rows are broadcast
    rows = with_statistics(rows, F.col("_text")).drop("_text")
    rows = materialize(rows.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled).coalesce(1), "labelled")
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if ones in (0, n):
        share = (ones + 1) / (n + 2)
        return RuleEnsemble(math.log(share / (1 - share)), [])
    cols = [f"f_{k}" for k in FEATURES]
    data = VectorAssembler(inputCols=cols, outputCol="stats").transform(rows)
    forest = RandomForestClassifier(featuresCol="stats", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=7,
                                    minInstancesPerNode=max(1, n // 500)).fit(data)
    found: dict[Rule, None] = {}
    for tree in forest.trees:
        found.update(dict.fromkeys(_paths(tree._java_obj.rootNode(), (), FEATURES)))
    rules = list(found)
    if not rules:
        share = (ones + 1) / (n + 2)
        return RuleEnsemble(math.log(share / (1 - share)), [])
    fired = rows.select("label", F.array(*[rule_column(r) for r in rules]).alias("fired"))
    fired = materialize(fired.select("label", F.expr("transform(fired, x -> float(x))").alias("fired")), "fired")
    from pyspark.ml.functions import array_to_vector
    model = LogisticRegression(featuresCol="v", labelCol="label", elasticNetParam=1.0, regParam=LASSO,
                               standardization=False, maxIter=200).fit(
        fired.select("label", array_to_vector(F.col("fired").cast("array<double>")).alias("v")))
    weights = model.coefficients.toArray()
    return RuleEnsemble(float(model.intercept), [(float(w), r) for w, r in zip(weights, rules, strict=True) if w != 0])


# ------------------------------------------------------------ applying
def score_table(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                accept: float = ACCEPT) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    model = fit(docs, labels, id_col, text_col)
    rows = with_statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), F.col("_text"))
    return (rows.withColumn("score", model.score())
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= accept).cast("int").alias("predicted")))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              accept: float = ACCEPT) -> DataFrame:
    """``docs`` without the rows that the classifier rejects."""
    model = fit(docs, labels, id_col, text_col)
    if not model.rules:
        return docs
    rows = with_statistics(packed(docs), F.col(f"_row.`{text_col}`"))
    return unpack(rows.filter(model.score() >= accept))
