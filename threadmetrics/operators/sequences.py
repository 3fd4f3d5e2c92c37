"""Fixed-length token id sequences and masked-token training rows.

Token ids come from a vocabulary table (word -> id); the special ids are
fixed below. Everything is array functions over one row per document, so
no document is ever split or regrouped beyond its own tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import MAX_SEQ_LEN, MLM_PROBABILITY
from .category import _uniform
from .skew import lookup_join

PAD_ID, UNK_ID, CLS_ID, SEP_ID, MASK_ID = 0, 1, 2, 3, 4
FIRST_WORD_ID = 5
IGNORE_LABEL = -100


def word_ids(vocab_index: DataFrame) -> DataFrame:
    """Vocabulary index (word, word_id 0..n-1) -> (word, tok_id) after the
    special ids."""
    return vocab_index.select("word", (F.col("word_id") + FIRST_WORD_ID).alias("tok_id"))


def encode(tokens: DataFrame, ids: DataFrame) -> DataFrame:
    """Token ids of every document in token order, unknown words -> UNK; a
    document without tokens has no ids (it is not dropped)."""
    pos = tokens.select("doc_id", F.posexplode_outer("tokens").alias("pos", "word"))
    j = lookup_join(pos, ids, ["word"])
    j = j.select("doc_id", F.when(F.col("word").isNotNull(), F.struct(
        "pos", F.coalesce("tok_id", F.lit(UNK_ID)).alias("tok_id"))).alias("_p"))   # collect_list skips nulls
    return (j.groupBy("doc_id")
            .agg(F.array_sort(F.collect_list("_p")).alias("_s"))
            .select("doc_id", F.transform("_s", lambda s: s["tok_id"]).alias("ids")))


def pad_truncate(ids: Column, max_len: int = MAX_SEQ_LEN) -> tuple[Column, Column]:
    """``[CLS] ids[:max_len-2] [SEP]`` padded with PAD to ``max_len``,
    and the attention mask (1 for real positions, 0 for padding)."""
    body = F.slice(ids, 1, max_len - 2)
    seq = F.concat(F.array(F.lit(CLS_ID)), body, F.array(F.lit(SEP_ID)))
    n = F.size(seq)
    padded = F.concat(seq, F.array_repeat(F.lit(PAD_ID), F.lit(max_len) - n))
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_len) - n))
    return padded, mask


def mask_tokens(doc_id: Column, ids: Column, vocab_size: int, seed: int = 42,
                prob: float = MLM_PROBABILITY) -> tuple[Column, Column]:
    """Choose ``prob`` of the non-special positions; of those 80% become
    MASK, half of the rest a random word id, the others stay; labels keep
    the original id at chosen positions and -100 elsewhere. Draws are md5
    bits of (seed, doc, position): reproducible under any partitioning."""
    def key(i):
        return F.concat(F.lit(f"{seed}:"), doc_id.cast("string"), F.lit(":"), i.cast("string"))

    def chosen(x, i):
        return (x >= FIRST_WORD_ID) & (_uniform(key(i), 0) <= prob)

    def new_id(x, i):
        rnd = (F.conv(F.substring(F.md5(key(i)), 25, 8), 16, 10).cast("bigint") % vocab_size
               + FIRST_WORD_ID).cast("int")
        return (F.when(~chosen(x, i), x)
                .when(_uniform(key(i), 1) <= 0.8, F.lit(MASK_ID))
                .when(_uniform(key(i), 2) <= 0.5, rnd)
                .otherwise(x))

    inputs = F.transform(ids, lambda x, i: new_id(x, i))
    labels = F.transform(ids, lambda x, i: F.when(chosen(x, i), x).otherwise(F.lit(IGNORE_LABEL)))
    return inputs, labels
