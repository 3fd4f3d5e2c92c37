"""Row-local TLC features on a stream of flat comments.

The reference has no streaming. The parts of the feature row that need no
reply tree (P1 and the TLC's own columns of P2: links, cleaned text, token
count, calendar parts) are row-local, so the same column expressions run
unchanged on a streaming DataFrame. Roll-ups over reply trees stay batch
jobs (a reply can arrive long after its TLC).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import text as tx
from ..sources.jsonl import COMMENTS_DDL


def tlc_row_features(comments: DataFrame) -> DataFrame:
    """Works on batch and streaming frames alike."""
    tlc = comments.filter(F.col("parent_id").isNull())
    u = F.col("created_utc")
    return tlc.select(
        F.col("comment_id").alias("Top_comment_id"), "post_id",
        F.col("sibling_ord").alias("Top_comment_order"),
        tx.link_count(F.col("body")).alias("Top_comment_link_count"),
        F.coalesce("score", F.lit(0)).alias("Top_comment_score"),
        tx.clean_text(F.col("body")).alias("Top_comment_text"),
        tx.token_count(tx.clean_text(F.col("body"))).cast("bigint").alias("Top_comment_word_count"),
        cal.utc_hour(u).alias("Top_comment_hour"), cal.utc_day(u).alias("Top_comment_day"),
        cal.utc_weekday(u).alias("Top_comment_day_of_week"))


def stream_tlc_features(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                        trigger_once: bool = True):
    """Parquet files of flat comments arriving in ``source_dir`` -> TLC
    feature rows appended to ``sink_dir`` (exactly once through the
    checkpoint). Returns the started query."""
    stream = spark.readStream.schema(COMMENTS_DDL).parquet(source_dir)
    w = (tlc_row_features(stream).writeStream.format("parquet").outputMode("append")
         .option("path", sink_dir).option("checkpointLocation", checkpoint_dir))
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="10 seconds")
    return w.start()
