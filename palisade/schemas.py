"""Declared schemas of feeds, reports and tables, and the 27 feature columns."""

from __future__ import annotations

from pyspark.sql import types as T

# The feature columns, in model order.
NETWORK_FEATURES = (
    "packets_per_second", "bytes_per_second", "avg_packet_size", "tcp_ratio", "udp_ratio", "icmp_ratio",
    "unique_dst_ports", "unique_src_ports", "high_port_ratio", "connection_count", "failed_connection_ratio",
    "syn_flood_score", "flow_duration", "flow_idle_time", "bidirectional_ratio", "payload_entropy",
    "avg_payload_size", "header_repetition_score", "packet_interval_std", "is_outbound", "is_non_allowlisted",
    "uses_non_standard_port",
)
MEMORY_FEATURES = (
    "mem_pslist_nproc", "mem_dlllist_ndlls", "mem_handles_nhandles", "mem_malfind_ninjections",
    "mem_ldrmodules_not_in_load",
)
FEATURES = NETWORK_FEATURES + MEMORY_FEATURES

_METRIC = "array<struct<cvssData:struct<baseScore:double,vectorString:string>>>"
NVD_RECORD = f"""struct<cve:struct<id:string,published:string,lastModified:string,
  descriptions:array<struct<lang:string,value:string>>,
  metrics:struct<cvssMetricV31:{_METRIC},cvssMetricV30:{_METRIC},cvssMetricV2:{_METRIC}>,
  configurations:array<struct<nodes:array<struct<cpeMatch:array<struct<vulnerable:boolean,criteria:string>>>>>>,
  references:array<struct<url:string,tags:array<string>>>>>"""
NVD_DOCUMENT = f"totalResults int, vulnerabilities array<{NVD_RECORD}>"

KEV_RECORD = """struct<cveID:string,vulnerabilityName:string,shortDescription:string,dateAdded:string,
  dueDate:string,requiredAction:string,vendorProject:string,product:string>"""
KEV_DOCUMENT = f"vulnerabilities array<{KEV_RECORD}>"

_PORT = "struct<state:string,name:string,product:string,version:string,extrainfo:string>"
SCAN_REPORT = f"""organization_id bigint, scan_id string, ip_address string, addresses struct<mac:string>,
  hostnames array<struct<name:string>>,
  osmatch array<struct<name:string,accuracy:string,osclass:array<struct<osfamily:string>>>>,
  tcp map<string,{_PORT}>, udp map<string,{_PORT}>"""
SERVICE = """struct<port:int,protocol:string,service:string,product:string,version:string,extrainfo:string>"""

FINDING = f"""organization_id bigint, scan_id string, ip_address string, mac_address string, hostname string,
  os_family string, os_version string, os_accuracy int, open_ports array<int>, services array<{SERVICE}>,
  is_server boolean, discovery_method string"""

ASSETS = f"""asset_id bigint, organization_id bigint, ip_address string, mac_address string, hostname string,
  os_family string, os_version string, is_server boolean, is_critical boolean, status string,
  open_ports array<int>, services array<{SERVICE}>, network_segment string, discovery_method string,
  first_seen_at timestamp, last_seen_at timestamp, updated_at timestamp"""

THREATS = """cve_id string, title string, description string, cvss_v3_score decimal(3,1), cvss_v3_vector string,
  cvss_v2_score decimal(3,1), severity string, cpe_matches array<string>, exploit_references array<string>,
  affected_products array<struct<vendor:string,product:string>>, is_exploited_in_wild boolean, source string,
  source_url string, published_at timestamp, last_modified_at timestamp, cisa_kev_added_at date,
  cisa_due_date date, cisa_required_action string, raw_data string, created_at timestamp, updated_at timestamp"""

# Allowed words of the enumerated columns ("general" is what fusion emits for the forest).
ALLOWED = {
    "asset_type": ("server", "workstation", "network_device", "iot_device", "mobile_device", "virtual_machine",
                   "container", "cloud_instance", "unknown"),
    "asset_status": ("active", "inactive", "decommissioned", "quarantined", "maintenance"),
    "severity": ("critical", "high", "medium", "low", "informational"),
    "vulnerability_status": ("open", "in_progress", "remediated", "accepted_risk", "false_positive"),
    "remediation_status": ("pending_approval", "approved", "rejected", "in_progress", "completed", "failed",
                           "rolled_back"),
    "threat_source": ("nist_nvd", "cisa_kev", "exploit_db", "internal_scan", "ml_detection", "manual_entry"),
    "anomaly_type": ("dos_loop", "backdoor_connection", "data_exfiltration", "lateral_movement",
                     "privilege_escalation", "suspicious_port", "unknown_destination", "protocol_anomaly", "general"),
    "role": ("admin", "analyst", "viewer", "api_service"),
    "direction": ("inbound", "outbound", "both"),
}


def struct_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
