"""Merging per-half metric tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import OUTCOME_METRICS

HALF_SUFFIX = {0: "_first_half", 1: "_second_half"}


def dedupe(df: DataFrame, key: list[str]) -> DataFrame:
    """One row per key, the same one under any partitioning: the
    smallest row (by all other columns) wins. ``min`` of a struct is
    partially aggregated, so a key with many copies is reduced map-side
    instead of being sent to one task."""
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.select(*key).distinct()
    m = df.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_m"))
    return m.select(*key, *[F.col("_m")[c].alias(c) for c in rest])


def rename(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    """Rename columns list to list."""
    return df.withColumnsRenamed(dict(zip(old, new)))


def halves_to_rows(wide: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """P5: a table with ``m_first_half`` / ``m_second_half`` columns becomes
    long form with a ``half`` column (0, 1) and plain metric names."""
    parts = []
    for half, suf in HALF_SUFFIX.items():
        parts.append(wide.select(F.col(key), F.lit(half).alias("half"),
                                 *[F.col(m + suf).alias(m) for m in metrics]))
    return parts[0].unionByName(parts[1])


def rows_to_halves(long: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Inverse of P5 (conditional aggregation), for wide exports."""
    aggs = []
    for half, suf in HALF_SUFFIX.items():
        aggs += [F.max(F.when(F.col("half") == half, F.col(m))).alias(m + suf) for m in metrics]
    return long.groupBy(key).agg(*aggs)


def merge_tables(tables: list[DataFrame], key: list[str], partitions: int | None = None) -> DataFrame:
    """Inner join of many tables on the same key. Every table is
    hash-partitioned on the key once, with the same partition count, so the
    chain of sort-merge joins adds no further shuffle."""
    if partitions:
        tables = [t.repartition(partitions, *key) for t in tables]
    return reduce(lambda a, b: a.join(b, key, "inner"), tables)


def outcome_projection(df: DataFrame, key: list[str]) -> DataFrame:
    """The key and the 26 outcome metrics."""
    return df.select(*key, *OUTCOME_METRICS)
