"""Scan reports: one JSON object per host, one line each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palisade.functions.software import has_server_port
from palisade.schemas import SCAN_REPORT


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCAN_REPORT).json(path)


def _open_services(ports: Column, protocol: str) -> Column:
    entries = F.filter(F.map_entries(ports), lambda e: e["value"]["state"] == "open")
    services = F.transform(entries, lambda e: F.struct(
        e["key"].try_cast("int").alias("port"), F.lit(protocol).alias("protocol"),
        e["value"]["name"].alias("service"), e["value"]["product"].alias("product"),
        e["value"]["version"].alias("version"), e["value"]["extrainfo"].alias("extrainfo")))
    empty = F.array().cast("array<struct<port:int,protocol:string,service:string,product:string,"
                           "version:string,extrainfo:string>>")
    return F.coalesce(services, empty)


def normalise(reports: DataFrame) -> DataFrame:
    """Reports to findings: first name and system match, open ports, services, server flag."""
    best = F.try_element_at("osmatch", F.lit(1))
    rows = reports.select(
        "organization_id", "scan_id", "ip_address",
        F.lower("addresses.mac").alias("mac_address"),
        F.try_element_at("hostnames", F.lit(1))["name"].alias("hostname"),
        F.try_element_at(best["osclass"], F.lit(1))["osfamily"].alias("os_family"),
        best["name"].alias("os_version"),
        F.when(best.isNotNull(), F.coalesce(best["accuracy"].try_cast("int"), F.lit(0))).alias("os_accuracy"),
        F.concat(_open_services(F.col("tcp"), "tcp"), _open_services(F.col("udp"), "udp")).alias("services"),
        F.lit("network_scan").alias("discovery_method"))
    ports = F.transform("services", lambda s: s["port"])
    return rows.withColumn("open_ports", ports).withColumn("is_server", has_server_port(F.col("open_ports")))


def service_rows(findings: DataFrame) -> DataFrame:
    """One row per service of a finding."""
    keep = [c for c in findings.columns if c != "services"]
    return findings.select(*keep, F.explode("services").alias("s")).select(*keep, "s.*")
