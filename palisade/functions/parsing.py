"""Tolerant parsing and path building."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ISO_SHAPE = (
    r"^\d{4}-\d{2}-\d{2}"
    r"([T ]\d{2}(:\d{2}(:\d{2}([.]\d{1,6})?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"
)


def parse_timestamp(text: Column) -> Column:
    """ISO text to timestamp; anything malformed becomes null."""
    return F.when(text.rlike(ISO_SHAPE), F.try_to_timestamp(text))


def parse_date(text: Column) -> Column:
    shaped = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), text)
    return F.try_to_date(shaped, "yyyy-M-d")


def date_path(ts: Column) -> Column:
    return F.date_format(ts, "yyyy/MM/dd")


def audit_path(prefix: str, org: Column, ts: Column) -> Column:
    return F.concat_ws("/", F.lit(prefix), org.cast("string"), date_path(ts))


def capture_path(prefix: str, org: Column, source_ip: Column, ts: Column) -> Column:
    name = F.concat(F.replace(source_ip, F.lit("."), F.lit("_")), F.lit("_"),
                    F.date_format(ts, "HHmmss"), F.lit(".pcap.gz"))
    return F.concat_ws("/", F.lit(prefix), org.cast("string"), date_path(ts), name)


def model_path(prefix: str, org: Column, name: Column, version: Column) -> Column:
    return F.concat_ws("/", F.lit(prefix), F.coalesce(org.cast("string"), F.lit("global")), name,
                       F.concat(F.lit("v"), version))


def model_version(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd.HHmmss")
