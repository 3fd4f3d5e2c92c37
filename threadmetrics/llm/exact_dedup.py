"""Exact duplicates, screened by static filters over immutable snapshots.

The corpus arrives in batches; every earlier batch is an immutable snapshot.
Rows are digested once (SHA-256 of the normalised text). Repeats inside a
batch are grouped by a partially aggregated group-by, so a text that makes
up a third of all rows is one row per task before any shuffle. For each
snapshot a set of static binary fuse filters is built, one per digest bucket
(distinct digests hash evenly, so a bucket's size is bounded by its number,
not by the data). A batch's digests are screened against the filters of the
earlier snapshots; positives join the exact buckets and every group of more
than one row is checked byte for byte by grouping on the text itself.

Defined results: null text counts as empty; equal means identical after
lower-casing A-Z; the row with the largest id stays (null ids are smallest,
of rows that also share the id one stays); an empty table gives an empty
result; no text is ever cut.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import lineage
from . import binary_fuse
from .common import ascii_lower, flagged, materialize, packed, unpack, with_uid

BATCHES = 4                  # three snapshots, then the incoming batch
DIGESTS_PER_BUCKET = 100_000
SALTS = 16                   # rows of one digest meet its entry in so many places


def _digest(text: Column) -> tuple[Column, Column]:
    norm = ascii_lower(text)
    return F.unhex(F.sha2(norm, 256)), F.xxhash64(norm)


def batch_of(id_col: Column, batches: int = BATCHES) -> Column:
    """The arrival batch of a row: 0 .. batches-1 by a hash of its id."""
    return F.pmod(F.xxhash64(id_col), F.lit(batches)).cast("int")


def salt(col: Column) -> Column:
    """A row's place among the SALTS places of its digest."""
    return F.pmod(F.xxhash64(col), F.lit(SALTS)).cast("int")


def salted(entries: DataFrame) -> DataFrame:
    """Entries (one row per digest) repeated at each place."""
    return entries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _build_filter(pdf: pd.DataFrame) -> pd.DataFrame:
    seed, seg, count, data = binary_fuse.build(pdf["key"].to_numpy().view(np.uint64))
    return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "batch": [pdf["batch"].iloc[0]], "seed": [seed],
                         "seg": [seg], "segments": [count], "prints": [data]})


def build_filters(digests: DataFrame) -> DataFrame:
    """One static filter per (bucket, batch) of ``digests`` (bucket, batch,
    key), as a table of bounded rows."""
    return digests.select("bucket", "batch", "key").groupBy("bucket", "batch").applyInPandas(
        _build_filter, "bucket int, batch int, seed int, seg int, segments int, prints binary")


def _screen(digests: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    keys = digests["key"].to_numpy().view(np.uint64)
    batch = digests["batch"].to_numpy()
    hit = np.zeros(len(digests), dtype=bool)
    for f in filters.itertuples():
        later = np.flatnonzero((batch > f.batch) & ~hit)
        if len(later):
            hit[later] = binary_fuse.contains((f.seed, f.seg, f.segments, f.prints), keys[later])
    return digests.loc[hit, ["digest"]]


def screen(digests: DataFrame, filters: DataFrame) -> DataFrame:
    """Digests that an earlier snapshot's filter lets through."""
    return (digests.select("bucket", "batch", "key", "digest").groupBy("bucket")
            .cogroup(filters.groupBy("bucket")).applyInPandas(_screen, "digest binary")).distinct()


def suspect_groups(lite: DataFrame, rows: int) -> DataFrame:
    """Groups of equal digests with more than one row: ``digest, check, n,
    last`` (last = id and row number of the row that stays). ``lite``: _uid,
    _id, digest, check, batch; ``rows``: their number."""
    buckets = max(8, rows // DIGESTS_PER_BUCKET + 1)
    per_batch = materialize(
        lite.groupBy("digest", "check", "batch")
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("_id", "_uid")).alias("last"))
        .withColumn("key", F.xxhash64("digest", "check"))
        .withColumn("bucket", F.pmod(F.hash("digest"), F.lit(buckets)).cast("int")), "batches")
    last_batch = F.lit(BATCHES - 1)
    filters = materialize(build_filters(per_batch.filter(F.col("batch") < last_batch)), "filters")
    hits = materialize(screen(per_batch.filter(F.col("batch") > 0), filters), "hits")

    flagged = per_batch.join(hits.withColumn("_hit", F.lit(True)), "digest", "left")
    across = (flagged.filter("_hit").groupBy("digest", "check")
              .agg(F.sum("n").alias("n"), F.max("last").alias("last")))
    within = flagged.filter("_hit is null").select("digest", "check", "n", "last")
    return materialize(across.unionByName(within).filter("n > 1"), "suspects")


def checked(rows: DataFrame, text: Column) -> DataFrame:
    """``digest, check, group_size, texts`` of the rows of suspect groups: they
    are grouped on the text itself (map-side combined), one text per digest is
    demanded of ``texts``."""
    return (rows.groupBy("digest", "check", ascii_lower(text).alias("norm"))
            .agg(F.count(F.lit(1)).alias("m"))
            .groupBy("digest", "check").agg(F.sum("m").alias("group_size"), F.count(F.lit(1)).alias("texts")))


def exact_groups(lite: DataFrame, texts: DataFrame, rows: int) -> DataFrame:
    """Byte-checked groups of equal texts with more than one row:
    ``digest, check, group_size, last`` (last = id and row number of the row
    that stays). ``lite``: _uid, _id, digest, check, batch; ``texts``:
    digest, check, _text and _salt (any column that varies between copies) for
    the same rows; ``rows``: their number."""
    suspects = suspect_groups(lite, rows)
    # Salted, so that the copies of one text spread.
    exact = checked(texts.withColumn("salt", salt(F.col("_salt")))
                    .join(salted(suspects.select("digest", "check")), ["digest", "check", "salt"], "left_semi"), F.col("_text"))
    return (suspects.join(exact, ["digest", "check"])
            .withColumn("_bad", F.assert_true(F.col("texts") == 1, F.lit("two texts share both digests")))
            .filter("_bad is null").select("digest", "check", "group_size", "last"))


def duplicate_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, dropped ones too: ``doc_id, keep_id, group_size,
    kept, text_sha256``."""
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    digest, check = _digest(F.col("_text"))
    tagged = src.withColumns({"digest": digest, "check": check, "batch": batch_of(F.col("_id"))})
    lite = materialize(with_uid(tagged.drop("_text")), "digests")
    groups = exact_groups(lite, tagged.select("digest", "check", "_text", F.col("_id").alias("_salt")), lite.count())
    return (lite.withColumn("salt", salt(F.col("_uid"))).join(salted(groups), ["digest", "check", "salt"], "left")
            .select(F.col("_id").alias("doc_id"),
                    F.when(F.col("last").isNull(), F.col("_id")).otherwise(F.col("last._id")).alias("keep_id"),
                    F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                    (F.col("last").isNull() | (F.col("last._uid") == F.col("_uid"))).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that an equal text with a larger id replaces."""
    digest, check = _digest(F.col("_text"))
    tagged = materialize(with_uid(packed(docs, _id=id_col, _text=text_col))
                         .withColumns({"digest": digest, "check": check, "batch": batch_of(F.col("_id"))})
                         .drop("_id", "_text"), "tagged")
    row_id, row_text = F.col(f"_row.`{id_col}`"), F.col(f"_row.`{text_col}`")
    lite = tagged.select("_uid", row_id.alias("_id"), "digest", "check", "batch")
    suspects = suspect_groups(lite, tagged.count())
    # Only row numbers and digests are joined; texts of suspect groups move, to be grouped, and no others.
    members = materialize(
        lite.select("_uid", "digest", "check", salt(F.col("_uid")).alias("salt"))
        .join(salted(suspects.select("digest", "check", "last")), ["digest", "check", "salt"])
        .select("_uid", (F.col("last._uid") != F.col("_uid")).alias("_goes")), "members")
    exact = checked(flagged(tagged, members, "_suspect").filter("_suspect"), row_text)
    if not exact.filter("texts <> 1").isEmpty():
        raise ValueError("two texts share both digests")
    kept = materialize(unpack(flagged(tagged, members.filter("_goes"), "_dropped").filter("not _dropped")), "kept")
    lineage.release(tagged)
    return kept
