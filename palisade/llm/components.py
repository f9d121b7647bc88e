"""Connected components of a table of links, by alternating large and small stars.

Each round re-links every node to the least node around it; stars with the least node of their component as the
centre are what stays. Every round is stored in the shared folder, so a lost executor repeats one round only.
A centre with very many links is one row on the small side of each join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return (joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())


def component_labels(links: DataFrame) -> DataFrame:
    """node, label: the least node that each linked node of ``links`` (u, v) can reach. Single nodes have no row."""
    links = stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                   "star")
    seen = _signature(links)
    while seen[0]:
        links = stored(_small_star(_large_star(links)), "star")
        now = _signature(links)
        if now == seen:
            break
        seen = now
    centres = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(centres)
