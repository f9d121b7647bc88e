"""Scan job records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palisade.operators.ranking import top_per_group

HISTORY_COLUMNS = ("scan_id", "scan_type", "target_specification", "status", "started_at", "completed_at",
                   "assets_discovered", "assets_updated", "vulnerabilities_found", "errors_encountered")


def job_counts(upserted: DataFrame, associations: DataFrame, errors: DataFrame) -> DataFrame:
    """Per scan: assets added and changed, associations made, errors met. Inputs carry ``scan_id``."""
    parts = [
        upserted.groupBy("scan_id").agg(
            F.count_if(F.col("action") == "new").alias("assets_discovered"),
            F.count_if(F.col("action") == "updated").alias("assets_updated")),
        associations.groupBy("scan_id").agg(F.count("*").alias("vulnerabilities_found")),
        errors.groupBy("scan_id").agg(F.count("*").alias("errors_encountered")),
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    names = ("assets_discovered", "assets_updated", "vulnerabilities_found", "errors_encountered")
    return stacked.groupBy("scan_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])


def first_errors(errors: DataFrame, k: int = 10) -> DataFrame:
    """The first ``k`` messages of each scan as one array; ``errors``: (scan_id, seq, message)."""
    kept = top_per_group(errors, ["scan_id"], [F.col("seq"), F.col("message")], k)
    rows = kept.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("seq", "message"))).alias("e"))
    return rows.select("scan_id", F.transform("e", lambda x: x["message"]).alias("first_errors"))


def discovered_addresses(findings: DataFrame) -> DataFrame:
    """The address list of a scan, as rows: a scan may find more than one cell can hold."""
    return findings.select("scan_id", "ip_address").distinct()


def summarise(upserted: DataFrame, associations: DataFrame, errors: DataFrame) -> DataFrame:
    return job_counts(upserted, associations, errors).join(first_errors(errors), "scan_id", "left")


def with_outcome(jobs: DataFrame) -> DataFrame:
    seconds = F.timestamp_diff("MICROSECOND", F.col("started_at"), F.col("completed_at")) / 1e6
    return (jobs.withColumn("duration_seconds", seconds)
            .withColumn("status", F.when(F.col("completed_at").isNotNull(), "completed").otherwise("failed")))


def history(jobs: DataFrame) -> DataFrame:
    return jobs.select(*HISTORY_COLUMNS)
