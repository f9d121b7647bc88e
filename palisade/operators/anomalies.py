"""Anomaly reads and acknowledgement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade.operators.ranking import last_per_key, matching


def list_anomalies(anomalies: DataFrame, kind=None, severity=None, acknowledged=None) -> DataFrame:
    """Filtered detections with the free-form fields packed into one JSON column."""
    rows = matching(anomalies, anomaly_type=kind, severity=severity, is_acknowledged=acknowledged)
    detail = [c for c in ("feature_vector", "investigation_notes") if c in rows.columns]
    return rows.withColumn("details", F.to_json(F.struct(*detail), {"ignoreNullFields": "false"}))


def recent(anomalies: DataFrame, as_of: Column, days: int) -> DataFrame:
    return anomalies.filter(F.col("detected_at") > as_of - F.make_interval(days=F.lit(days)))


def by_type_and_severity(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("organization_id", "anomaly_type", "severity").agg(
        F.count("*").alias("detections"),
        F.count_if("is_false_positive").alias("false_positives"),
        F.avg("confidence_score").alias("avg_confidence"))


def hourly_timeline(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("organization_id", F.date_trunc("hour", "detected_at").alias("hour")).agg(
        F.count("*").alias("detections"), F.avg("confidence_score").alias("avg_confidence"))


def acknowledge(anomalies: DataFrame, commands: DataFrame, as_of: Column, order: list[str] = ()) -> DataFrame:
    """``commands``: (detection_id, acknowledged_by, notes, is_false_positive); the last per detection by ``order`` wins."""
    c = last_per_key(commands, ["detection_id"], order).select(
        "detection_id", F.col("acknowledged_by").alias("__by"), F.col("notes").alias("__notes"),
        F.coalesce("is_false_positive", F.lit(False)).alias("__fp"))
    joined = anomalies.join(c, "detection_id", "left")
    hit = F.col("__by").isNotNull()
    changed = {"is_acknowledged": F.lit(True), "acknowledged_by": F.col("__by"), "acknowledged_at": as_of,
               "investigation_notes": F.col("__notes"), "is_false_positive": F.col("__fp"), "updated_at": as_of}
    kept = [x for x in anomalies.columns if x not in changed]
    fresh = [F.when(hit, v).otherwise(F.col(x) if x in anomalies.columns else None).alias(x)
             for x, v in changed.items()]
    return joined.select(*kept, *fresh)


def false_positive_share(anomalies: DataFrame, as_of: Column, days: int = 7, minimum: int = 100) -> DataFrame:
    """Share per organisation; null up to ``minimum`` detections, where it says too little."""
    counts = recent(anomalies, as_of, days).groupBy("organization_id").agg(
        F.count("*").alias("detections"), F.count_if("is_false_positive").alias("false_positives"))
    share = F.when(F.col("detections") > minimum, F.col("false_positives") / F.col("detections"))
    return counts.withColumn("false_positive_share", share)
