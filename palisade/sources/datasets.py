"""CSV datasets, training files and object listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.operators.features import benign_by_words
from palisade.schemas import FEATURES


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, so a file with other columns needs no inference pass; numbers are cast where used."""
    return spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option(
        "ignoreTrailingWhiteSpace", True).csv(path)


def read_feature_csv(spark: SparkSession, path: str, columns=FEATURES) -> DataFrame:
    """Only the feature columns of benign rows, stored as floats."""
    df = benign_by_words(read_csv(spark, path))
    return df.select(*[F.col(c).try_cast("float").alias(c) for c in columns if c in df.columns])


def read_training_files(spark: SparkSession, path: str, columns=FEATURES) -> DataFrame:
    """All readable parquet files below a folder; unreadable ones are skipped, none at all is an error."""
    schema = ", ".join(f"`{c}` double" for c in columns)
    df = (spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
          .option("ignoreCorruptFiles", True).parquet(path))
    if df.isEmpty():
        raise ValueError(f"no training data below {path}")
    return df


def silent_training_files(spark: SparkSession, path: str, columns=FEATURES) -> DataFrame:
    """path, size of the parquet files that ``read_training_files`` took no row from: broken ones, or empty ones."""
    schema = ", ".join(f"`{c}` double" for c in columns)
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    read = (spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
            .option("ignoreCorruptFiles", True).parquet(path).select(plain("_metadata.file_path").alias("path")).distinct())
    there = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
             .load(path).select(plain("path").alias("path"), F.col("length").alias("size")))
    return there.join(read, "path", "left_anti")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def list_objects(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and time of every file; contents are never opened."""
    return read_files(spark, path).select(
        F.col("path").alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))


def list_part_objects(spark: SparkSession, path: str) -> DataFrame:
    """Objects stored in parts, as uploads of many parts are: a folder of part files is one object.

    (key, size, last_modified, parts); no task has to write or read an object whole.
    """
    parts = list_objects(spark, path)
    return parts.groupBy(F.regexp_extract("key", r"(?s)^(.*)/[^/]*$", 1).alias("key")).agg(
        F.sum("size").alias("size"), F.max("last_modified").alias("last_modified"), F.count("*").alias("parts"))
