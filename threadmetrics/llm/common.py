"""Small shared pieces of the training-data operators.

Rows are addressed by an internal row number (``_uid``) assigned once and
written to the shared checkpoint folder, so repeated ids, null ids and
repeated rows never merge by accident. Input columns travel packed in one
struct (``_row``), so extra columns of any name cannot clash with internal
ones.
"""

from __future__ import annotations

import functools
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lineage, skew
from ..sources.tables import read_table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
# One word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

# Scratch tables. A pipeline stage notes the tables that it writes under a
# token, which travels as column metadata with the stage's result; Parquet keeps
# it. The next stage, whose input carries the token, knows that the result has
# been written and deletes exactly those tables.
_TOKEN = "threadmetrics.scratch"
_stages: dict[str, list[str]] = {}
_thread = threading.local()


def materialize(df: DataFrame, name: str = "state") -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and reread."""
    stored = lineage.materialize(df, name)
    if getattr(_thread, "tables", None) is not None:
        _thread.tables.append(stored._tm_path)
    return stored


def stage(fn: Callable) -> Callable:
    """A pipeline stage ``(spark, docs, sf_dir) -> DataFrame`` that first deletes
    the scratch tables of the stage whose written result ``docs`` is. Tables of
    other stages, runs and operators are never touched."""
    @functools.wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release_stage(docs)
        outer, _thread.tables = getattr(_thread, "tables", None), []
        try:
            out = fn(spark, docs, sf_dir)
            token = uuid.uuid4().hex
            _stages[token] = _thread.tables
        finally:
            _thread.tables = outer
        first = out.columns[0]
        return out.withMetadata(first, {**out.schema[first].metadata, _TOKEN: token})
    return run


def release_stage(docs: DataFrame) -> None:
    """Delete the scratch tables of the stage that made ``docs``, but for those
    that ``docs`` reads itself (a result that has not been written)."""
    tokens = {f.metadata[_TOKEN] for f in docs.schema.fields if _TOKEN in f.metadata} & set(_stages)
    if not tokens:
        return
    files = docs.inputFiles()
    for token in tokens:
        held = [p for p in _stages[token] if any(p.removeprefix("file:").strip("/") in f for f in files)]
        for path in _stages[token]:
            if path not in held:
                lineage.delete(docs.sparkSession, path)
        _stages[token] = held


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty. ``lower`` is the same on
    all-ASCII text and much faster than a character map."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def packed(docs: DataFrame, **cols: str) -> DataFrame:
    """``_row`` (all input columns) plus the named columns copied out of it:
    ``packed(docs, _text="text")``."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       *[F.col(f"`{c}`").alias(name) for name, c in cols.items()])


def with_uid(df: DataFrame) -> DataFrame:
    """``df`` plus ``_uid``, unique per row. The caller materializes the
    result before using it twice: the numbers depend on the partitioning."""
    return df.withColumn("_uid", F.monotonically_increasing_id())


HOT_ROWS = 20_000         # rows of one key that one task may get
MAX_HOT_KEYS = 10_000


def hot_keys(df: DataFrame, key: str, limit: int = HOT_ROWS) -> DataFrame:
    """``key, _parts`` of the keys with more than ``limit`` rows of the stored
    ``df``: into how many parts their rows go. The limit rises with the table so
    that there are never more than ``MAX_HOT_KEYS`` such keys."""
    limit = max(limit, -(-df.count() // MAX_HOT_KEYS))
    return (df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") > limit).select(key, F.ceil(F.col("_n") / limit).cast("int").alias("_parts")))


def hot_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``left.join(right, key, how)`` (inner, left, left_semi or left_anti) for
    a stored ``left`` of which one key may have a large share and a ``right``
    with one row per key: rows of a frequent key are dealt over several tasks,
    each with a copy of its one right row."""
    if skew.planner_broadcasts(right):
        return left.join(right, key, how)
    hot = materialize(hot_keys(left, key), "hot")
    if hot.isEmpty():
        return left.join(right, key, how)
    few = F.broadcast(hot)         # at most MAX_HOT_KEYS keys and a number each
    parts = F.coalesce("_parts", F.lit(1))
    dealt = (left.join(few, key, "left").withColumn("_part", F.pmod(F.monotonically_increasing_id(), parts).cast("int"))
             .drop("_parts"))
    copies = (right.join(few, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
              .drop("_parts"))
    return dealt.join(copies, [key, "_part"], how).drop("_part")


MAX_BITMAPS = 8192        # broadcast at most; 4 KB for 32,768 row numbers each


def _bit(bits: Column, at: Column) -> Column:
    """Bit ``at`` of a bitmap of ``bitmap_construct_agg``: 0 or 1."""
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return F.getbit(byte, at.bitwiseAND(7).cast("int"))


def flagged(rows: DataFrame, listed: DataFrame, name: str, most: int = MAX_BITMAPS) -> DataFrame:
    """``rows`` plus a boolean ``name``: is the row's ``_uid`` among those of
    ``listed``? The rows, which hold whole texts, stay where they lie: the list
    comes to them as bitmaps, one bit per row number. A list of more than ``most``
    bitmaps is not broadcast; then the rows move, once, to meet it."""
    # Parted by bucket before the aggregation: no task makes bitmaps of a bucket of which it has only some numbers.
    maps = materialize(
        listed.select("_uid", F.bitmap_bucket_number("_uid").alias("_bucket")).repartition("_bucket").groupBy("_bucket")
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_uid")).alias("_bits")), "bitmaps")
    found = F.broadcast(maps) if maps.count() <= most else maps.hint("merge")
    return (rows.withColumn("_bucket", F.bitmap_bucket_number("_uid")).join(found, "_bucket", "left")
            .withColumn(name, F.coalesce(_bit(F.col("_bits"), F.bitmap_bit_position("_uid")) == 1, F.lit(False)))
            .drop("_bucket", "_bits"))


def unpack(df: DataFrame) -> DataFrame:
    """The input columns again."""
    return df.select("_row.*")


def bound_arrow(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds: texts can be long, so both the rows
    and the bytes of a batch handed to Python are limited."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
