"""Audit archive, capture manifests, integrity and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade.functions.parsing import audit_path, capture_path
from palisade.operators.merging import set_where_listed
from palisade.operators.quality import FLAGS, PATH_PATTERNS
from palisade.operators.ranking import top_per_group

# Path roots, ages and limits.
AUDIT_PREFIX = "audit-trails"
CAPTURE_PREFIX = "pcap-logs"
ARCHIVE_AFTER_DAYS = 30
ARCHIVE_ROWS = 10000  # what the parity query takes at once
CAPTURE_DAYS = 365
AUDIT_YEARS = 7


def archive_batch(audit: DataFrame, as_of: Column, days: int = ARCHIVE_AFTER_DAYS, k: int | None = None) -> DataFrame:
    """All due unarchived rows, or the oldest ``k`` per organisation, with the place each will have.

    ``audit``: audit_id, organization_id, created_at, archive_path and payload columns.
    """
    due = audit.filter((F.col("created_at") < as_of - F.make_interval(days=F.lit(days)))
                       & F.col("archive_path").isNull())
    batch = due if k is None else top_per_group(due, ["organization_id"], [F.col("created_at"), F.col("audit_id")], k)
    return batch.withColumn("archive_path", audit_path(AUDIT_PREFIX, F.col("organization_id"), F.col("created_at")))


def write_archive(batch: DataFrame, path: str) -> None:
    """Gzip JSON lines by organisation and the date of each row."""
    at = F.col("created_at")
    (batch.withColumn("org", F.col("organization_id")).withColumn("y", F.date_format(at, "yyyy"))
     .withColumn("m", F.date_format(at, "MM")).withColumn("d", F.date_format(at, "dd"))
     .hint("rebalance", "org", "y", "m", "d")  # few files; Spark splits what one day of an organisation has too much
     .write.mode("append").partitionBy("org", "y", "m", "d").option("compression", "gzip").json(path))


def mark_archived(audit: DataFrame, batch: DataFrame) -> DataFrame:
    return set_where_listed(audit, batch, "audit_id", "archive_path")


def capture_manifest(captures: DataFrame, digests: DataFrame) -> DataFrame:
    """``captures``: organization_id, source_ip, capture_time and the path of the stored file; ``digests``: path, length, digest."""
    at = F.col("capture_time")
    return captures.join(digests.hint("merge"), "path").select(  # a listing's size is not known before it is made
        "organization_id", "source_ip", "capture_time",
        capture_path(CAPTURE_PREFIX, F.col("organization_id"), F.col("source_ip"), at).alias("key"),
        F.col("length").alias("size_bytes"), F.col("digest").alias("sha256"),
        F.date_add(F.to_date(at), CAPTURE_DAYS).alias("retain_until"))


def integrity_report(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that differ from the manifest, both (path, digest); a listed file that cannot be read through is changed.

    ``found`` comes from ``files.file_digests`` or, for very large files, ``files.tree_digests``.
    """
    now = found.select("path", F.col("digest").alias("found_digest"), F.lit(True).alias("there"))
    rows = manifest.select("path", F.col("digest").alias("expected_digest"), F.lit(True).alias("known")).join(now, "path", "full_outer")
    status = (F.when(F.col("known").isNull(), "unexpected").when(F.col("there").isNull(), "missing")
              .when(~F.col("expected_digest").eqNullSafe(F.col("found_digest")) | F.col("found_digest").isNull(), "changed"))
    return rows.withColumn("status", status).filter(F.col("status").isNotNull()).drop("known", "there")


def file_policy(files: DataFrame, extensions: list[str], max_mb: float = 100) -> DataFrame:
    """``files`` (path, length[, content]) with the cleaned name and every broken rule.

    Only the rule on null bytes needs the content; without that column it is left out and no file is opened.
    """
    name = F.element_at(F.split("path", "/"), -1)
    safe = F.regexp_replace(name, r"(?U)[^\w\s.-]", "")
    suffix = F.lower(F.regexp_extract(safe, r"^.+(\.[^.]+)$", 1))
    traversal = F.lit(False)
    for pattern in PATH_PATTERNS:
        traversal = traversal | F.col("path").rlike(FLAGS + pattern)
    broken = F.array_compact(F.array(
        F.when(traversal, "path_traversal"),
        F.when(~suffix.isin(*extensions), "extension") if extensions else F.lit(None).cast("string"),
        F.when(F.col("length") > max_mb * 1024 * 1024, "too_large"),
        F.when(F.contains(F.col("content"), F.lit(b"\x00")), "null_bytes") if "content" in files.columns else F.lit(None).cast("string")))
    return files.select("path", safe.alias("safe_name"), "length", broken.alias("violations"))


def retention_due(manifest: DataFrame, as_of: Column) -> DataFrame:
    """Archive entries past their time; ``manifest``: kind (capture, audit), stored_at."""
    until = F.when(F.col("kind") == "capture", F.date_add(F.to_date("stored_at"), CAPTURE_DAYS)).when(
        F.col("kind") == "audit", F.add_months(F.to_date("stored_at"), 12 * AUDIT_YEARS))
    return manifest.withColumn("retain_until", until).filter(F.col("retain_until") < F.to_date(as_of))
