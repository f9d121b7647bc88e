"""Shards by weighted rendezvous hashing of a stable record key.

Every (key, shard) pair has a draw u in (0, 1); the record goes to the shard with the highest ``-weight / ln(u)``.
A further shard only takes records to itself, and a changed weight moves records to or from that shard alone.

Defined cases: a null key is the key "null"; repeated keys share a shard; a null text counts as no bytes; an
empty table gives no rows; other columns pass through whatever they are called.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stored, unit_draw

SEED = "shard"


def rendezvous(key: Column, weights: Sequence[float], seed: str = SEED) -> Column:
    """The index of the shard that wins ``key``; the lower index wins a tie."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    scores = []
    for shard, weight in enumerate(weights):
        draw = unit_draw(F.concat(text, F.lit(f":{shard}")), seed)
        # draws are multiples of 2**-52; half a step keeps the logarithm finite
        score = F.lit(-float(weight)) / F.ln(draw + F.lit(2.0 ** -53)) if weight > 0 else F.lit(-1.0)
        scores.append(F.struct(score.alias("score"), F.lit(-shard).alias("shard")))
    return (-F.greatest(*scores)["shard"] if len(scores) > 1 else F.lit(0)).cast("int")


def assign_shards(docs: DataFrame, n_shards: int = 16, weights: Sequence[float] | None = None, key: str = "doc_id",
                  seed: str = SEED, column: str = "shard") -> DataFrame:
    """``docs`` with the shard of each row: one projection, nothing is shuffled."""
    return docs.withColumn(fresh(docs, column), rendezvous(docs[key], weights or [1.0] * n_shards, seed))


def with_slots(rows: DataFrame, shard: str, order: Sequence[str], slot: str = "slot") -> DataFrame:
    """``rows`` with their rank in their shard, from 0 and without gaps, by ``order``.

    Rows are range-partitioned by (shard, order, row) and stored; a row's rank is the number of rows of its shard
    in earlier partitions plus its place in its own. Ties are spread by a row number, so no partition depends on
    how many rows share a shard or a key.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie, part = fresh(rows, "tie"), fresh(rows, "part")
    ranged = (rows.withColumn(tie, F.monotonically_increasing_id())
              .repartitionByRange(parts, shard, *order, tie).withColumn(part, F.spark_partition_id()))
    ranged = stored(ranged, "shard-ranges")
    counts = ranged.groupBy(shard, part).count()
    before = Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offset, n = fresh(ranged, "before"), fresh(ranged, "count")
    counts = counts.withColumnRenamed("count", n).select(
        F.col(shard).alias(f"{shard}__"), F.col(part).alias(f"{part}__"),
        F.coalesce(F.sum(n).over(before), F.lit(0)).alias(offset))
    place = F.row_number().over(Window.partitionBy(shard, part).orderBy(*order, tie))
    return (ranged.withColumn(slot, place - 1)
            .join(counts, (F.col(shard) == F.col(f"{shard}__")) & (F.col(part) == F.col(f"{part}__")))
            .withColumn(slot, (F.col(slot) + F.col(offset)).cast("long"))
            .drop(tie, part, offset, f"{shard}__", f"{part}__"))
