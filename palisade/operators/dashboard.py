"""Per-organisation counters over four tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

COUNTERS = ("total_assets", "active_assets", "open_vulnerabilities", "unacked_anomalies", "pending_remediations")


def organisation_counts(assets: DataFrame, vulns: DataFrame, anomalies: DataFrame, tasks: DataFrame) -> DataFrame:
    """Each table is counted on its own; the small results are stacked and summed, not joined."""
    parts = [
        assets.groupBy("organization_id").agg(
            F.count("*").alias("total_assets"), F.count_if(F.col("status") == "active").alias("active_assets")),
        vulns.groupBy("organization_id").agg(
            F.count_if(F.col("status") == "open").alias("open_vulnerabilities")),
        anomalies.groupBy("organization_id").agg(F.count_if(~F.col("is_acknowledged")).alias("unacked_anomalies")),
        tasks.groupBy("organization_id").agg(
            F.count_if(F.col("status") == "pending_approval").alias("pending_remediations")),
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.groupBy("organization_id").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS])
