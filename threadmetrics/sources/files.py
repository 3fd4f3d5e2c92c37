"""Delimited files, word lists, dictionaries and versioned data sets
(S2, S4-S12). No schema inference; no single-task output."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_tsv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Headered TSV with an explicit schema. Cleaned text holds no line
    breaks (T1), so a file is split between tasks at line ends."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema, quote='"', escape='"')


def write_tsv(df: DataFrame, path: str) -> None:
    """Headered TSV with alphabetically sorted columns, one file per
    task (never funnelled into one task)."""
    df.select(*sorted(df.columns)).write.mode("overwrite").csv(
        path, sep="\t", header=True, quote='"', escape='"')


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """One word per line, trimmed, blank lines dropped."""
    return spark.read.text(path).select(F.trim("value").alias("word")).filter(F.col("word") != "")


def read_category_dict(spark: SparkSession, path: str) -> DataFrame:
    """JSON objects ``{name: id}`` -> rows (name, category_id). A file holds
    one or many of them, each on a line of its own, or a single one laid out
    over several lines; any other file is an error."""
    def parsed(text: str):
        return F.from_json(text, "map<string,bigint>")

    def pairs(rows: DataFrame, whole):
        bad = F.raise_error(F.concat(F.lit("not a category dictionary: "), F.col("file"))).cast("map<string,bigint>")
        return rows.select(F.explode(F.when(whole, parsed("value")).otherwise(bad)).alias("name", "category_id"))

    def read(**options):
        return spark.read.text(path, **options).select("value", F.col("_metadata.file_path").alias("file"))
    lines = read().filter(F.trim("value") != "")
    spread = [r["file"] for r in lines.filter(parsed("value").isNull()).select("file").distinct().collect()]
    if not spread:
        return pairs(lines, parsed("value").isNotNull())
    # without its strings, a single object holds one opening brace
    bare = F.regexp_replace("value", r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")
    single = parsed("value").isNotNull() & bare.rlike(r"^\s*\{[^{}]*\}\s*$")
    return pairs(lines.filter(~F.col("file").isin(spread)), parsed("value").isNotNull()).unionByName(
        pairs(read(wholetext=True).filter(F.col("file").isin(spread)), single))


def write_category_dict(dictionary: DataFrame, path: str) -> None:
    """One ``{name: id}`` object per line, one file per task."""
    pair = F.create_map(F.col("name"), F.col("category_id"))
    dictionary.select(F.to_json(pair).alias("value")).write.mode("overwrite").text(path)


def read_embedding_csv(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """Headerless ``name, f0..f{dim-1}`` -> (name, embedding array<float>)."""
    ddl = "name string, " + ", ".join(f"f{i} float" for i in range(dim))
    df = spark.read.csv(path, header=False, schema=ddl)
    return df.select("name", F.array(*[F.col(f"f{i}") for i in range(dim)]).alias("embedding"))


def write_embedding_csv(df: DataFrame, name_col: str, vec_col: str, dim: int, path: str) -> None:
    df.select(F.col(name_col).cast("string"), *[F.col(vec_col)[i] for i in range(dim)]).write.mode(
        "overwrite").csv(path, header=False)


def dataset_path(base: str, name: str, version: str) -> str:
    return os.path.join(base, name, f"v={version}")


def save_dataset(df: DataFrame, base: str, name: str, version: str) -> DataFrame:
    """Materialise a prepared data set under a version key and return
    the stored copy (later runs read it instead of recomputing)."""
    path = dataset_path(base, name, version)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def load_or_build(spark: SparkSession, base: str, name: str, version: str, build) -> DataFrame:
    """Reuse a stored version if present, else build and store it."""
    path = dataset_path(base, name, version)
    if path_exists(spark, os.path.join(path, "_SUCCESS")):
        return spark.read.parquet(path)     # an unreadable version raises, it is never overwritten
    return save_dataset(build(), base, name, version)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Is there a file or folder at ``path``, in whatever store it names?"""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def replace_labels(dataset: DataFrame, labels: DataFrame, key: str, label_col: str) -> DataFrame:
    """Lay new labels over a prepared data set, whose rows all stay.

    A row whose key has a new label takes it, also a null one; every other row,
    one with a null key among them, keeps its old label (null where the data
    set had no such column). A key with more than one new label is an error."""
    old = dataset if label_col in dataset.columns else dataset.withColumn(
        label_col, F.lit(None).cast(labels.schema[label_col].dataType))
    said = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.concat(F.lit("more than one label for key "), F.col(key).cast("string")))
                  .cast(labels.schema[label_col].dataType)).otherwise(F.first(label_col))
    new = (labels.filter(F.col(key).isNotNull()).groupBy(key).agg(said.alias("_label"))
           .select(F.col(key).alias("_key"), "_label", F.lit(True).alias("_new")))
    out = old.join(new, F.col(key) == F.col("_key"), "left")
    return out.withColumn(label_col, F.when(F.col("_new"), F.col("_label")).otherwise(F.col(label_col))).select(*old.columns)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Combine several training files by column name; a file with
    other columns is an error."""
    return reduce(lambda a, b: a.unionByName(b), frames)
