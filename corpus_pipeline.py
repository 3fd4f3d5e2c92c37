"""The corpus pipeline: documents to packed training sequences.

``STAGES`` lists (name, function) pairs; each function takes
``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet below the shared checkpoint folder and reread as the next stage's
``docs``. All stages but the last return the columns of ``documents``. A stage
first deletes the scratch tables of the stage whose result it gets, which has
been written by then, so the folder holds one stage's intermediate tables of a
run at a time; tables of other runs and operators are never touched.

Defined results: null texts count as empty and null ids are the smallest;
repeated rows are copies, of which one stays; empty tables give no rows; extra
columns travel along to the last stage; texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmetrics.llm import exact_dedup, mixing, packing, quality, simhash
from threadmetrics.llm.common import materialize, read_table, release_stage, stage
from threadmetrics.operators import lineage

# Mixing: shares of the domains' tokens are raised to this power and scaled so
# that no domain has to shrink; every document stays at least once.
TEMPERATURE = 0.7


@stage
def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go (operator 9)."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


@stage
def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays (operator 3)."""
    return exact_dedup.drop_duplicates(docs)


@stage
def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class stays (operator 10)."""
    return simhash.drop_near_duplicates(docs)


@stage
def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their fitted rates, towards tempered language
    shares (operator 4)."""
    labelled = docs.select("doc_id", F.col("lang").alias("domain")).join(
        read_table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id")
    return mixing.mixed(docs, labelled, temperature=TEMPERATURE, min_rate=1.0, keep_all=True)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids placed in sequences of 2048 (operator 8); ids as
    little-endian 16-bit numbers, as the vocabulary has under 65,536 entries."""
    return packing.pack(packing.token_pieces(docs, dtype="<u2"))


STAGES = [
    ("quality", filter_quality),
    ("exact_dedup", dedup_exact),
    ("near_dedup", dedup_near),
    ("mixing", mix_languages),
    ("packing", pack_sequences),
]

# The classifier's fitted weights cannot be expressed in SQL; the stages are
# tested one by one against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, function in STAGES:
        before, docs = docs, materialize(function(spark, docs, sf_dir), f"stage-{name}")
        lineage.release(before)      # a table of this run; the input table is left alone
    release_stage(docs)
    return docs
