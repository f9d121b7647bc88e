"""Asset inventory: scoping, listing, exposure counts, upsert and quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade.operators.merging import merge_rows
from palisade.operators.ranking import matching

DEFAULT_RANGE = "192.168.0.0/16"
LISTENER_PORT = 1024


def tenant_scope(df: DataFrame, org) -> DataFrame:
    return df.filter(F.col("organization_id") == F.lit(org))


def list_assets(assets: DataFrame, status: str | None = None, critical: bool | None = None) -> DataFrame:
    return matching(assets, status=status, is_critical=critical)


def exposure_counts(assets: DataFrame, vulns: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Assets with their open vulnerabilities and unacknowledged anomalies.

    Each side is counted per asset before the join, so nothing fans out; its id is its key.
    """
    open_vulns = (vulns.filter(F.col("status") == "open").groupBy("asset_id")
                  .agg(F.count("vulnerability_id").alias("vulnerability_count")))
    pending = (anomalies.filter(~F.col("is_acknowledged")).groupBy("asset_id")
               .agg(F.count("detection_id").alias("anomaly_count")))
    return (assets.join(open_vulns, "asset_id", "left").join(pending, "asset_id", "left")
            .fillna(0, ["vulnerability_count", "anomaly_count"]))


def suspicious_listeners(assets: DataFrame, threshold: int = LISTENER_PORT) -> DataFrame:
    """Active non-servers that listen above the threshold (``open_ports`` array)."""
    return assets.filter((F.col("status") == "active") & ~F.col("is_server")
                         & F.exists("open_ports", lambda p: p > threshold))


def licensed(orgs: DataFrame, as_of: Column) -> DataFrame:
    return orgs.filter(F.col("license_expires_at") > as_of)


def ml_enabled(orgs: DataFrame, as_of: Column) -> DataFrame:
    return licensed(orgs, as_of).filter(F.get_json_object("features", "$.ml_enabled") == "true")


def scan_ranges(assets: DataFrame, orgs: DataFrame, default: str = DEFAULT_RANGE) -> DataFrame:
    """Every segment an organisation uses, or the default range where it has none."""
    used = (assets.filter(F.col("network_segment").isNotNull())
            .select("organization_id", "network_segment").distinct())
    return (orgs.select("organization_id").join(used, "organization_id", "left")
            .select("organization_id", F.coalesce("network_segment", F.lit(default)).alias("network_segment")))


def quarantine(assets: DataFrame, commands: DataFrame, as_of: Column) -> DataFrame:
    """Set the status of commanded assets; ``commands`` has (organization_id, asset_id)."""
    marked = commands.select("organization_id", "asset_id").distinct().withColumn("__hit", F.lit(True))
    joined = assets.join(marked, ["organization_id", "asset_id"], "left")
    hit = F.col("__hit").isNotNull()
    return (joined.withColumn("status", F.when(hit, "quarantined").otherwise(F.col("status")))
            .withColumn("updated_at", F.when(hit, as_of).otherwise(F.col("updated_at"))).drop("__hit"))


def upsert_assets(assets: DataFrame, findings: DataFrame, as_of: Column, order: list[str] = ()) -> DataFrame:
    """Fold findings into the inventory, one row per (org, ip); adds ``action``.

    A host found more than once counts as last found by ``order`` (the end of the scan, say). Null identity fields in a finding keep the known value; everything a scan
    observes directly is replaced.
    """
    keep = ["mac_address", "hostname", "os_family", "os_version"]
    replace = ["is_server", "open_ports", "services"]
    matched = {c: lambda o, n: F.coalesce(n, o) for c in keep}
    matched |= {c: lambda o, n: n for c in replace}
    matched |= {"status": lambda o, n: F.lit("active"),
                "last_seen_at": lambda o, n: as_of, "updated_at": lambda o, n: as_of}
    inserted = {c: None for c in keep + replace + ["discovery_method"]}
    inserted |= {"status": F.lit("active"), "first_seen_at": as_of, "last_seen_at": as_of, "updated_at": as_of}
    return merge_rows(assets, findings, ["organization_id", "ip_address"], matched, inserted, order, keep)


def resolve_assets(df: DataFrame, assets: DataFrame, ip_column: str = "source_ip") -> DataFrame:
    """Add the asset id behind an address, null where unknown."""
    lookup = assets.select("organization_id", F.col("ip_address").alias(ip_column), "asset_id")
    return df.join(lookup, ["organization_id", ip_column], "left")


def split_by_asset(tasks: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks whose asset exists (with host and address), and those to reject."""
    lookup = assets.select("asset_id", "hostname", "ip_address")
    found = tasks.join(lookup, "asset_id", "inner")
    lost = (tasks.join(lookup.select("asset_id"), "asset_id", "left_anti")
            .withColumn("reject_reason", F.lit("asset_not_found")))
    return found, lost
