"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.session import scratch_dir

# The white space that separates words, and what splits a text into letters-and-digits words.
WHITE = " \t\n\u000b\f\r"
PLAIN_WORD = r"[^\x20\x09-\x0D]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Stands for "no id" where an id is compared; it sorts after every other id.
NO_ID = 9223372036854775807


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and its size is known.

    ``codec`` is another compression than the session's.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` stored with a number of its own for each row, and the name of that column."""
    row = fresh(df, "row_number")
    return stored(df.withColumn(row, F.monotonically_increasing_id()), label), row


def id_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def ascii_lower(column: Column) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    return F.translate(column, UPPER, LOWER)


def unit_draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on ``key`` and ``seed`` alone: the first 52 bits of an MD5 digest."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(2 ** 52))
