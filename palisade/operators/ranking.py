"""Row limits and rankings that stay safe when one group holds much of the data."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.session import scratch_dir

#: Up to here Spark cuts a ranked group on the map side (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000
SALT = "__salt"
RANK = "__rank"


def plain_columns(df: DataFrame) -> list[str]:
    """The columns that a hash can be taken of."""
    return [f.name for f in df.schema if not {"map", "variant"} & set(re.findall(r"\w+", f.dataType.simpleString()))]


def matching(df: DataFrame, **wanted) -> DataFrame:
    """Keep rows equal to every given value; a ``None`` means no condition."""
    return reduce(lambda d, kv: d.filter(F.col(kv[0]) == F.lit(kv[1])),
                  [(k, v) for k, v in wanted.items() if v is not None], df)


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One result page under a total order (callers append the key)."""
    return df.orderBy(*order).offset(offset).limit(limit)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, salts: int = 32) -> DataFrame:
    """The first ``k`` rows of every group, exactly.

    Groups are first cut to ``k`` inside ``salts`` random-looking slices, so no
    task ever sorts a whole hot group; the second cut sees at most ``k * salts``
    rows of a group. A ``k`` that Spark does not cut on the map side goes by
    ranges of the order instead. ``order`` must be total.
    """
    if k > GROUP_LIMIT:
        return first_by_ranges(df, keys, order, k)
    slices = Window.partitionBy(*keys, SALT).orderBy(*order)
    groups = Window.partitionBy(*keys).orderBy(*order)
    salted = df.withColumn(SALT, F.pmod(F.xxhash64(*plain_columns(df)), F.lit(salts)))
    cut = salted.withColumn(RANK, F.row_number().over(slices)).filter(F.col(RANK) <= k)
    return (cut.withColumn(RANK, F.row_number().over(groups))
            .filter(F.col(RANK) <= k).drop(SALT, RANK))


def first_by_ranges(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of every group, for any ``k``.

    Rows are range-partitioned by (group, order) and stored, so a hot group is many ranges. How many rows of a group
    lie in earlier ranges is counted; ranges that begin behind the ``k``-th row are dropped whole, and a rank inside
    one range is all that is left to do.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_dir(spark, "ranges")
    ranged = df.repartitionByRange(parts, *keys, *order).withColumn(SALT, F.spark_partition_id())
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    before = Window.partitionBy(*keys).orderBy(SALT).rowsBetween(Window.unboundedPreceding, -1)
    counts = (ranged.groupBy(*keys, SALT).agg(F.count("*").alias("__n"))
              .withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).filter(F.col("__before") < k)
              .select(*[F.col(c).alias(f"__key{i}") for i, c in enumerate(keys)], F.col(SALT).alias("__part"), "__before"))
    same = F.col(SALT) == F.col("__part")
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"__key{i}"))
    place = F.row_number().over(Window.partitionBy(*keys, SALT).orderBy(*order))
    return (ranged.join(counts, same).withColumn(RANK, place + F.col("__before")).filter(F.col(RANK) <= k)
            .select(*df.columns))


def last_per_key(df: DataFrame, keys: list[str], order: list[str] = (), keep: list[str] = ()) -> DataFrame:
    """One row per key: the last by ``order``, equal orders by a hash of the row, so that any order is total.

    Columns in ``keep`` hold their last value that is not null. A maximum, so it combines before the shuffle.
    """
    place = F.struct(*order, F.xxhash64(*plain_columns(df)))
    rest = [c for c in df.columns if c not in keys and c not in keep]
    parts = [F.max_by(F.struct(*rest), place).alias("__row")] if rest else []
    parts += [F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"__{c}") for c in keep]
    if not parts:
        return df.select(*keys).distinct()
    values = [F.col(c) if c in keys else F.col(f"__{c}" if c in keep else f"__row.{c}").alias(c) for c in df.columns]
    return df.groupBy(*keys).agg(*parts).select(*values)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row of every key; a maximum, so it combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*order)
    packed = F.max_by(F.struct(*rest), rank).alias("__row")
    return df.groupBy(*keys).agg(packed).select(*keys, "__row.*").select(*df.columns)
