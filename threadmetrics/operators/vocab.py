"""Vocabulary by document frequency and topic-model text (T7, F3-F5, F9,
F10, A9-A11, O1, J4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.fixed import MIN_VALID_TOKENS, STOP_WORDS, VOCAB_MAX_DOC_SHARE, VOCAB_MIN_DOC_FREQ
from .indexing import global_index
from .lineage import materialize
from .skew import lookup_join


def stop_words(spark) -> DataFrame:
    return spark.createDataFrame([(w,) for w in STOP_WORDS], "word string")


def token_docs(docs: DataFrame, id_col: str, text_col: str, clean: bool = True) -> DataFrame:
    """:func:`all_token_docs` with more than 10 valid tokens."""
    return all_token_docs(docs, id_col, text_col, clean).filter(F.size("tokens") > MIN_VALID_TOKENS)


def all_token_docs(docs: DataFrame, id_col: str, text_col: str, clean: bool = True) -> DataFrame:
    """Tokenise (T2), normalise (T7) and drop invalid tokens (F9), once: the
    table is written to the shared folder, so neither a filter on the tokens
    nor the vocabulary job's second read runs the tokeniser again."""
    text = tx.clean_text(F.col(text_col)) if clean else F.col(text_col)
    return materialize(docs.select(F.col(id_col).alias("doc_id"),
                                   F.coalesce(tx.valid_tokens(text), F.array().cast("array<string>")).alias("tokens")),
                       "tokens")


def doc_freq(tokens: DataFrame) -> DataFrame:
    """Number of documents containing each word (distinct per document
    before the shuffle)."""
    return (tokens.select(F.explode(F.array_distinct("tokens")).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("doc_freq")))


def vocabulary(tokens: DataFrame, low: int = VOCAB_MIN_DOC_FREQ,
               high_share: float = VOCAB_MAX_DOC_SHARE) -> DataFrame:
    """F4 + O1: words with ``low <= df < high_share * N`` (N = documents
    after F3, A10), minus the stop words (small fixed list, broadcast)."""
    n_docs = tokens.count()
    band = doc_freq(tokens).filter((F.col("doc_freq") >= low) & (F.col("doc_freq") < high_share * n_docs))
    return materialize(band.join(F.broadcast(stop_words(tokens.sparkSession)), "word", "left_anti"), "vocabulary")


def in_vocab(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """Rows whose ``word`` is in the vocabulary. Frequent words are hot
    keys, so the lookup splits them; whether the vocabulary is broadcast is
    the planner's decision by its bytes."""
    return lookup_join(rows, vocab.select("word"), ["word"], "left_semi")


def filter_to_vocab(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """F10 + F5 + J4: keep in-vocabulary tokens in their order, drop
    documents left empty; ``(doc_id, text_for_topic_modeling)``."""
    pos = tokens.select("doc_id", F.posexplode("tokens").alias("pos", "word"))
    kept = in_vocab(pos, vocab)
    return (kept.groupBy("doc_id")
            .agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("_t"))
            .select("doc_id", F.array_join(F.transform("_t", lambda s: s["word"]), " ")
                    .alias("text_for_topic_modeling")))


def bag_of_words(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Each document as ``id:count`` pairs over vocabulary ids (ids are
    positions of the words in sorted order, 0-based), ascending by id."""
    ids = global_index(vocab.select("word"), ["word"], "word_id")
    # counted within the document first: a frequent word is one row per document
    words = tokens.select("doc_id", F.explode("tokens").alias("word")).groupBy("doc_id", "word").agg(
        F.count(F.lit(1)).alias("cnt"))
    counts = lookup_join(words, ids, ["word"], "inner").select("doc_id", "word_id", "cnt")
    return (counts.groupBy("doc_id")
            .agg(F.array_sort(F.collect_list(F.struct("word_id", "cnt"))).alias("_b"))
            .select("doc_id", F.array_join(F.transform(
                "_b", lambda s: F.concat(s["word_id"].cast("string"), F.lit(":"), s["cnt"].cast("string"))),
                " ").alias("bow")))
