"""Exact order statistics without a global sort."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from palisade.session import scratch_dir

#: Of the sketch that brackets a rank: its error is one part in so many of the rows.
ACCURACY = 10_000


def order_statistics(df: DataFrame, column: str, ranks: list[int]) -> dict[int, float]:
    """The values at 0-based ``ranks`` of a numeric column, nulls left out; NaN comes after all other values.

    A pass takes a lower and an upper value around the wanted ranks from a quantile sketch, counts exactly how many
    rows lie below, on, between and above them, and goes on with the open region that holds the rank. Both values
    leave the search with each pass and the region shrinks by a factor of about a thousand, whatever the spread or
    the number of equal values; a region under ``ACCURACY`` rows is answered by the sketch itself. Only two values
    and five counts reach the driver.
    """
    x = F.col(column)
    rows = df.filter(x.isNotNull()).select(x.cast("double").alias(column))
    total, numbers = rows.agg(F.count("*"), F.count_if(~F.isnan(x))).first()
    for rank in ranks:
        if not 0 <= rank < total:
            raise ValueError(f"rank {rank} outside 0..{total - 1}")
    found = {r: math.nan for r in ranks if r >= numbers}
    # open regions: rows, how many rows lie before the region, its rows, its wanted ranks
    work = [(rows.filter(~F.isnan(x)), 0, numbers, sorted({r for r in ranks if r < numbers}))]
    while work:
        region, before, n, wanted = work.pop()
        if not wanted:
            continue
        margin = 2 / ACCURACY
        shares = [max(0.0, (wanted[0] - before) / n - margin), min(1.0, (wanted[-1] - before + 1) / n + margin)]
        low, high = region.agg(F.percentile_approx(x, shares, ACCURACY)).first()[0]
        parts = {"below": x < low, "low": x == low, "between": (x > low) & (x < high), "high": (x == high) & (x > low), "above": x > high}
        counts = region.agg(*[F.count_if(c).alias(k) for k, c in parts.items()]).first()
        for name, condition in parts.items():
            inside = [r for r in wanted if before <= r < before + counts[name]]
            if name in ("low", "high"):
                found |= {r: low if name == "low" else high for r in inside}
            elif inside:
                work.append((region.filter(condition), before, counts[name], inside))
            before += counts[name]
    return found


def order_statistic(df: DataFrame, column: str, rank: int) -> float:
    return order_statistics(df, column, [rank])[rank]


def quantile(df: DataFrame, column: str, share: float) -> float:
    """Linearly interpolated quantile, as numpy's default defines it; both neighbours come from one search."""
    total = df.filter(F.col(column).isNotNull()).count()
    place = share * (total - 1)
    base = int(place)
    found = order_statistics(df, column, sorted({base, min(base + 1, total - 1)}))
    below, above = found[base], found[min(base + 1, total - 1)]
    return below if place == base or below == above else below + (above - below) * (place - base)


# --- all groups at once ---------------------------------------------------------------------

#: Bits of the value that a pass decides.
DIGIT = 16


def ordered_keys(df: DataFrame, group: str, column: str) -> DataFrame:
    """(group, value, key) of the rows with a value; the whole numbers ``key`` are in the order of the doubles."""
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.ascontiguousarray(batch.column(1).to_numpy()).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits ^ (bits >> 63 & np.int64(2**63 - 1)))], ["g", "value", "key"])

    rows = df.select(F.col(group).alias("g"), F.col(column).cast("double").alias("value")).filter(F.col("value").isNotNull())
    kind = df.schema[group].dataType.simpleString()
    return rows.mapInArrow(keyed, f"g {kind}, value double, key long")


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def group_quantiles(df: DataFrame, group: str, column: str, share: float, name: str = "quantile") -> DataFrame:
    """The linearly interpolated quantile of every group, exact: (group, ``name``).

    Radix selection: four passes each decide 16 bits of the two neighbours of the wanted place, for all groups
    together, from a histogram of the rows that agree with the bits decided so far. Histograms combine before the
    shuffle and have at most 65,536 bins a group, so neither many groups nor a large one gathers rows anywhere.
    Values may be infinite; NaN comes last; groups without a value are left out.
    """
    rows = _written(ordered_keys(df, group, column), "quantile-keys")
    place = F.lit(share) * (F.col("n") - 1)
    base = F.floor(place).cast("long")
    wanted = rows.groupBy("g").agg(F.count("*").alias("n")).select(
        "g", (place - base).alias("part"), F.explode(F.array(
            F.struct(F.lit(0).alias("side"), base.alias("rank")),
            F.struct(F.lit(1).alias("side"), F.least(base + 1, F.col("n") - 1).alias("rank")))).alias("w")).select("g", "part", "w.*")
    for shift in range(64 - DIGIT, -1, -DIGIT):
        narrowed = rows
        if shift < 64 - DIGIT:
            regions = wanted.select(F.col("g").alias("of"), F.col("bits").alias("region")).distinct()
            narrowed = rows.join(regions, F.col("g").eqNullSafe(F.col("of")) & (F.shiftright("key", shift + DIGIT) == F.col("region")))
        bins = narrowed.groupBy("g", F.shiftright("key", shift).alias("bin")).agg(F.count("*").alias("m"), F.min("value").alias("value"))
        if shift < 64 - DIGIT:
            bins = bins.withColumn("region", F.shiftright("bin", DIGIT))
        else:
            bins, wanted = bins.withColumn("region", F.lit(0)), wanted.withColumn("bits", F.lit(0))
        before = F.sum("m").over(Window.partitionBy("g", "region").orderBy("bin")) - F.col("m")
        bins = bins.withColumn("before", before).withColumnsRenamed({"g": "of", "value": "found"})
        inside = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("m"))
        wanted = _written(
            wanted.select("g", "part", "side", "rank", "bits").join(bins, F.col("g").eqNullSafe(F.col("of")) & (F.col("bits") == F.col("region")) & inside)
            .select("g", "part", "side", (F.col("rank") - F.col("before")).alias("rank"), F.col("bin").alias("bits"), "found"), "quantile-bits")
    below, above = (F.max(F.when(F.col("side") == side, F.col("found"))) for side in (0, 1))
    part = F.max("part")
    # equal neighbours, infinite ones among them, need no interpolation
    return wanted.groupBy(F.col("g").alias(group)).agg(
        F.when((part == 0) | (below == above), below).otherwise(below + (above - below) * part).alias(name))
