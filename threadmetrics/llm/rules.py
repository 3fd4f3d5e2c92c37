"""Host-level quality rules, as DataFrame and SQL functions only.

Word, symbol and repetition counts of every whole text are array expressions
(no shuffle). Rule failures are aggregated by host, each host's failure rate
per rule is shrunk towards the corpus rate with a beta prior fitted over all
hosts (method of moments), and a host whose shrunk rate of some rule exceeds
``MAX_RATE`` is refused; the verdicts are joined back to the documents. A host
with a third of all rows is partially aggregated before the shuffle, and the
join back is salted.

Defined results: null text has no words; a null host is one host of its own;
repeated rows are judged alike; an empty table gives an empty result; texts
are read whole (one row's arrays grow with its own text only). Words of a
window are compared by a 64-bit hash of the three words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

MIN_WORDS = 50
SALTS = 16
MAX_RATE = 0.8              # shrunk share of a host's documents that fail one rule
WHITE = r"[\x20\x09-\x0D]+"


def with_counts(df: DataFrame, text: Column) -> DataFrame:
    """``df`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long)."""
    df = df.withColumn("_t", F.coalesce(text, F.lit("")))
    df = df.withColumns({"_w": F.filter(F.split("_t", WHITE), lambda w: w != ""),
                         "_l": F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    last = F.size("_w") - 3
    windows = F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(
        F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))))
    df = df.withColumn("_h", windows)
    # windows in hash order with their positions, only where some window repeats
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(
        F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("_s", lambda x, i: F.coalesce(x["h"] == F.get("_s", i - 1)["h"], F.lit(False))
                     | F.coalesce(x["h"] == F.get("_s", i + 1)["h"], F.lit(False)))
    df = df.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    # each repeated window adds the words that the one before it does not cover
    covered = F.aggregate("_p", F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n")),
                          lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(3), p - a["at"])).alias("n")),
                          lambda a: a["n"])
    counts = {
        "n_words": F.size("_w"),
        "word_chars": F.length(F.array_join("_w", "")),
        "n_symbols": F.regexp_count("_t", F.lit("[#*$%&|<>]")),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
    }
    return df.withColumns({k: v.cast("long") for k, v in counts.items()}).drop("_t", "_w", "_l", "_h", "_s", "_p")


def rules() -> dict[str, Column]:
    """Rule name -> does the document fail it (integer arithmetic only)."""
    n = F.col("n_words")
    return {
        "few_words": n < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "short_words": F.col("word_chars") < 2 * n,
        "long_words": F.col("word_chars") > 12 * n,
        "same_lines": 10 * F.col("n_dup_lines") > n,
    }


def host_verdicts(judged: DataFrame, names: list[str], max_rate: float = MAX_RATE) -> DataFrame:
    """``host, host_failed`` from one row per document with a 0/1 column
    ``r_<rule>`` for each rule."""
    sums = judged.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"r_{k}").alias(k) for k in names])
    long = sums.select("host", "n", F.explode(F.create_map(*[x for k in names for x in (F.lit(k), F.col(k))]))
                       .alias("rule", "failed"))
    rate = F.col("failed") / F.col("n")
    m, v = F.col("m"), F.col("v")
    prior = (long.groupBy("rule").agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"))
             # alpha + beta of the beta distribution with this mean and variance, within 1 .. 1e6
             .select("rule", "m", F.when(v > 0, F.least(F.lit(1e6), F.greatest(F.lit(1.0), m * (1 - m) / v - 1)))
                     .otherwise(1e6).alias("weight")))
    shrunk = (F.col("failed") + m * F.col("weight")) / (F.col("n") + F.col("weight"))
    return (long.join(F.broadcast(prior), "rule")        # one row per rule
            .groupBy("host").agg((F.max(shrunk) > max_rate).alias("host_failed")))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          max_rate: float = MAX_RATE) -> DataFrame:
    """One row per document: id, the five counts, base_failed and kept."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(host_col), F.lit("\u0000null")).alias("host"),
                      F.col(text_col).alias("_text"))
    tests = rules()
    counted = materialize(with_counts(src, F.col("_text")).drop("_text"), "counts")
    judged = counted.withColumns({f"r_{k}": c.cast("int") for k, c in tests.items()})
    verdicts = (host_verdicts(judged, list(tests), max_rate)
                .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    base = tests["few_words"] | tests["repeats"]
    return (counted.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
            .join(verdicts, ["host", "salt"])
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    base.alias("base_failed"), (~base & ~F.col("host_failed")).alias("kept")))
