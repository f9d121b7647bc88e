"""Threat catalogue: search, totals, feed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade.operators.merging import merge_rows
from palisade.operators.ranking import latest_per_key
from palisade.operators.searching import containing

KEV_FIELDS = ("cisa_kev_added_at", "cisa_due_date", "cisa_required_action")
NVD_KEPT = ("title", "description", "cvss_v3_score", "cvss_v3_vector", "cvss_v2_score")
NVD_REPLACED = ("cpe_matches", "exploit_references", "last_modified_at", "raw_data")
INSERTED = NVD_KEPT + NVD_REPLACED + KEV_FIELDS + (
    "severity", "is_exploited_in_wild", "source", "source_url", "published_at", "affected_products")


def search(threats: DataFrame, term: str) -> DataFrame:
    """Case-insensitive substring over id, title and description, reading them all; ``searching.TextIndex`` does not."""
    return containing(threats, term)


def search_order() -> list[Column]:
    return [F.col("cvss_v3_score").desc_nulls_last(), F.col("cve_id")]


def by_id(threats: DataFrame, cve_id: str) -> DataFrame:
    return threats.filter(F.col("cve_id") == F.upper(F.lit(cve_id)))


def totals(threats: DataFrame, as_of: Column) -> DataFrame:
    return threats.agg(
        F.count("*").alias("total_cves"),
        F.count_if("is_exploited_in_wild").alias("exploited_count"),
        F.count_if(F.col("severity") == "critical").alias("critical_count"),
        F.count_if(F.col("severity") == "high").alias("high_count"),
        F.count_if(F.col("cisa_due_date") > as_of).alias("pending_kev_count"),
        F.max("updated_at").alias("last_update"))


def sync_bookmark(threats: DataFrame) -> DataFrame:
    """Latest update per source, where the next incremental sync starts."""
    return threats.groupBy("source").agg(F.max("updated_at").alias("last_sync"))


def last_in_batch(batch: DataFrame) -> DataFrame:
    """One row per id; the later modification, then the later position, wins."""
    return latest_per_key(batch, ["cve_id"], ["last_modified_at", "ordinal"])


def _insert_rule(as_of: Column) -> dict:
    return {c: None for c in INSERTED} | {"updated_at": as_of, "created_at": as_of}


def apply_nvd(threats: DataFrame, batch: DataFrame, as_of: Column, keep_kev_severity: bool = False) -> DataFrame:
    """Fold NVD records in; source and exploited-catalogue columns stay as they are."""
    rules = {c: lambda o, n: F.coalesce(n, o) for c in NVD_KEPT}
    rules |= {c: lambda o, n: n for c in NVD_REPLACED}
    listed = F.col("o")["cisa_kev_added_at"].isNotNull() if keep_kev_severity else F.lit(False)
    rules["severity"] = lambda o, n: F.when(listed, o).otherwise(n)
    rules["updated_at"] = lambda o, n: as_of
    return merge_rows(threats, batch, ["cve_id"], rules, _insert_rule(as_of))


def apply_kev(threats: DataFrame, batch: DataFrame, as_of: Column) -> DataFrame:
    """Fold exploited-catalogue records in: always exploited, always critical."""
    rules = {c: lambda o, n: F.coalesce(n, o) for c in KEV_FIELDS}
    rules |= {"is_exploited_in_wild": lambda o, n: F.lit(True),
              "severity": lambda o, n: F.when(o.isNotNull(), "critical"),
              "updated_at": lambda o, n: as_of}
    return merge_rows(threats, batch, ["cve_id"], rules, _insert_rule(as_of))
