"""Rule detectors, fusion with the forest, and detection rows.

Rule scores add up in integer tenths, so comparisons at the flag thresholds are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade.functions.severity import severity_from_confidence
from palisade.functions.text import integer_packets

FLOOD_RATE = 1000.0
FLOOD_FLAG_TENTHS = 5
BACKDOOR_FLAG_TENTHS = 4
# The feature snapshot kept with a detection.
SNAPSHOT = ("packets_per_second", "bytes_per_second", "avg_packet_size", "tcp_ratio", "udp_ratio",
            "unique_dst_ports", "connection_count", "header_repetition_score", "packet_interval_std")


def _tenths(rules: list[tuple[Column, int]]) -> Column:
    total = F.lit(0)
    for condition, points in rules:
        total = total + F.when(condition, points).otherwise(0)
    return F.least(F.lit(10), total)


def flood_rules(df: DataFrame, rate: float = FLOOD_RATE) -> DataFrame:
    """Adds ``is_flood`` and ``flood_score``."""
    c = F.col
    # Thresholds and points, in tenths.
    tenths = _tenths([
        (c("packets_per_second") > rate, 4),
        (c("header_repetition_score") > 0.7, 3),
        (c("packet_interval_std") < 0.001, 2),
        (c("syn_flood_score") > 0.5, 3),
        ((c("connection_count") > 100) & (c("failed_connection_ratio") > 0.8), 2),
    ])
    return df.withColumn("is_flood", tenths > FLOOD_FLAG_TENTHS).withColumn("flood_score", tenths / 10)


def backdoor_rules(df: DataFrame) -> DataFrame:
    """Adds ``is_backdoor`` and ``backdoor_score``."""
    c = F.col
    # Thresholds and points, in tenths.
    tenths = _tenths([
        ((c("is_outbound") != 0) & (c("is_non_allowlisted") != 0), 4),
        (c("uses_non_standard_port") != 0, 2),
        ((c("packet_interval_std") > 0.01) & (c("packet_interval_std") < 0.1), 2),
        (c("payload_entropy") < 3.0, 1),
        (c("high_port_ratio") > 0.8, 1),
    ])
    return (df.withColumn("is_backdoor", tenths > BACKDOOR_FLAG_TENTHS)
            .withColumn("backdoor_score", tenths / 10))


def apply_rules(df: DataFrame, rate: float = FLOOD_RATE) -> DataFrame:
    return backdoor_rules(flood_rules(df, rate))


def fuse(scored: DataFrame, tie_rule: str = "batch") -> DataFrame:
    """Verdict per row from both rule detectors and the forest.

    Input has is_flood, flood_score, is_backdoor, backdoor_score, is_anomaly,
    anomaly_score. With ``single`` a backdoor must beat the flood score; with
    ``batch`` its flag suffices.
    """
    if tie_rule not in ("batch", "single"):
        raise ValueError(f"unknown tie rule {tie_rule!r}")
    flood = F.col("is_flood") & (F.col("flood_score") > F.col("backdoor_score"))
    backdoor = F.col("is_backdoor")
    if tie_rule == "single":
        backdoor = backdoor & (F.col("backdoor_score") > F.col("flood_score"))
    kind = (F.when(flood, "dos_loop").when(backdoor, "backdoor_connection")
            .when(F.col("is_anomaly"), "general").otherwise("normal"))
    confidence = (F.when(flood, F.col("flood_score")).when(backdoor, F.col("backdoor_score"))
                  .when(F.col("is_anomaly"), F.col("anomaly_score")).otherwise(1 - F.col("anomaly_score")))
    return (scored.withColumn("anomaly_type", kind).withColumn("confidence_score", confidence)
            .withColumn("severity", severity_from_confidence(F.col("confidence_score"), F.col("anomaly_type"))))


def _details() -> Column:
    flood = F.to_json(F.struct("packets_per_second", "header_repetition_score", "syn_flood_score"))
    backdoor = F.to_json(F.struct(
        "destination_ip", (F.col("is_non_allowlisted") == 0).alias("is_allowlisted"),
        (F.col("uses_non_standard_port") == 0).alias("uses_standard_port")))
    forest = F.to_json(F.struct("anomaly_score"))
    kind = F.col("anomaly_type")
    return F.when(kind == "dos_loop", flood).when(kind == "backdoor_connection", backdoor).otherwise(forest)


def detection_rows(fused: DataFrame, assets: DataFrame, version: Column) -> DataFrame:
    """Rows to append for everything that is not normal, with the source asset where known."""
    lookup = assets.select("organization_id", F.col("ip_address").alias("source_ip"), "asset_id")
    rows = (fused.filter(F.col("anomaly_type") != "normal")
            .join(lookup, ["organization_id", "source_ip"], "left"))
    return rows.select(
        "organization_id", "asset_id", "anomaly_type", "severity", version.alias("detection_model_version"),
        "confidence_score", "source_ip", "destination_ip", F.col("window_start").alias("detected_at"),
        integer_packets(F.col("packets_per_second"), F.col("flow_duration")).alias("packet_count"),
        "packets_per_second", F.to_json(F.struct(*SNAPSHOT)).alias("feature_vector"), _details().alias("details"))


def scoring_statistics(fused: DataFrame) -> DataFrame:
    """Predictions, anomalies and their rate per organisation."""
    anomalies = F.count_if(F.col("anomaly_type") != "normal")
    return fused.groupBy("organization_id").agg(
        F.count("*").alias("prediction_count"), anomalies.alias("anomaly_count"),
        F.coalesce(F.try_divide(anomalies, F.count("*")), F.lit(0.0)).alias("anomaly_rate"))
