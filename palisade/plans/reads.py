"""Analytical reads: listing, counting, ranking and text search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from palisade.fixtures import EVENT_CLOCK, ORDER_CLOCK
from palisade.functions.severity import severity_from_confidence, severity_from_scores, severity_rank
from palisade.functions.software import has_server_port
from palisade.functions.text import integer_packets, invert_score
from palisade.operators import anomalies as anom
from palisade.operators import dashboard, inventory, threats as thr, vulnerabilities as vuln
from palisade.operators.merging import insert_missing, set_where_listed
from palisade.operators.ranking import latest_per_key, page, top_per_group
from palisade.operators.searching import TextIndex
from palisade.plans.registry import query
from palisade.session import scratch_dir


def event_clock():
    return F.to_timestamp_ntz(F.lit(EVENT_CLOCK))


def order_clock():
    return F.to_timestamp_ntz(F.lit(ORDER_CLOCK))


EVENT_SQL = f"TIMESTAMP '{EVENT_CLOCK}'"
ORDER_SQL = f"TIMESTAMP '{ORDER_CLOCK}'"

SEVERITY_SQL = """CASE WHEN {s} IS NULL THEN 'medium' WHEN {s} >= 9 THEN 'critical' WHEN {s} >= 7 THEN 'high'
     WHEN {s} >= 4 THEN 'medium' WHEN {s} > 0 THEN 'low' ELSE 'informational' END""".format(
    s="(CASE WHEN cvss_v3_score <> 0 THEN cvss_v3_score ELSE cvss_v2_score END)")
RANK_SQL = "CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 ELSE 5 END"
GRADED_SQL = f"graded AS (SELECT *, {SEVERITY_SQL} AS severity FROM known_threats)"
SCOPED_SQL = """scoped AS (SELECT v.*, a.organization_id FROM asset_vulnerabilities v
     JOIN assets a ON a.asset_id = v.asset_id)"""


def graded(t):
    """Threats with their severity."""
    return t.known_threats.withColumn(
        "severity", severity_from_scores(F.col("cvss_v3_score"), F.col("cvss_v2_score")))


def scoped_vulns(t):
    """Vulnerabilities with the organisation of their asset."""
    return t.asset_vulnerabilities.join(t.assets.select("asset_id", "organization_id"), "asset_id")


def scoped_tasks(t):
    return t.remediation_tasks.join(t.assets.select("asset_id", "organization_id"), "asset_id")


def vuln_tasks(t):
    """Tasks that name a vulnerability: the lines of the task's order, as (task, vulnerability)."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("task_id"), F.col("l_partkey").alias("threat_id"))
    return (t.remediation_tasks.join(lines, "task_id")
            .withColumn("vulnerability_id", F.col("asset_id") * 1000000 + F.col("threat_id")).drop("threat_id"))


@query("flt1_tenant_scope", """
SELECT * FROM assets WHERE organization_id = 7""")
def _(t):
    return inventory.tenant_scope(t.assets, 7)


@query("flt2_so1_asset_list", """
SELECT asset_id, organization_id, hostname, status, is_critical, last_seen_at FROM (
  SELECT a.*, e.last_seen_at FROM assets a JOIN (
    SELECT user_id AS asset_id, max(ts) AS last_seen_at FROM events GROUP BY user_id) e ON e.asset_id = a.asset_id)
WHERE status = 'active' AND is_critical = FALSE
ORDER BY last_seen_at DESC, asset_id LIMIT 100 OFFSET 20""")
def _(t):
    seen = t.events.groupBy(F.col("user_id").alias("asset_id")).agg(F.max("ts").alias("last_seen_at"))
    rows = inventory.list_assets(t.assets.join(seen, "asset_id"), status="active", critical=False)
    return page(rows.select("asset_id", "organization_id", "hostname", "status", "is_critical", "last_seen_at"),
                [F.desc("last_seen_at"), F.col("asset_id")], 100, 20)


@query("flt3_so2_vulnerability_list", f"""
WITH {GRADED_SQL}, {SCOPED_SQL}
SELECT v.vulnerability_id, v.asset_id, v.threat_id, v.organization_id, v.detected_at, v.status, v.is_exploitable,
       k.cve_id, k.severity, k.cvss_v3_score
FROM scoped v JOIN graded k ON k.threat_id = v.threat_id
WHERE v.status = 'open' AND k.severity = 'high'
ORDER BY k.cvss_v3_score DESC NULLS LAST, v.detected_at DESC, v.vulnerability_id LIMIT 200 OFFSET 10""")
def _(t):
    rows = vuln.list_vulnerabilities(
        vuln.with_threats(scoped_vulns(t), graded(t)), status="open", severity="high")
    return page(rows, [F.desc_nulls_last("cvss_v3_score"), F.desc("detected_at"), F.col("vulnerability_id")], 200, 10)


@query("flt4_so4_anomaly_list", """
SELECT detection_id, asset_id, anomaly_type, severity, confidence_score, detected_at, is_acknowledged,
       '{"feature_vector":' || coalesce('"' || anomaly_type || '"', 'null') || ',"investigation_notes":null}' AS details
FROM anomaly_detections WHERE anomaly_type = 'dos_loop' AND severity = 'high' AND is_acknowledged = FALSE
ORDER BY detected_at DESC, detection_id LIMIT 150 OFFSET 5""")
def _(t):
    source = (t.anomaly_detections.withColumn("feature_vector", F.col("anomaly_type"))
              .withColumn("investigation_notes", F.lit(None).cast("string")))
    rows = anom.list_anomalies(source, kind="dos_loop", severity="high", acknowledged=False)
    return page(rows.select("detection_id", "asset_id", "anomaly_type", "severity", "confidence_score",
                            "detected_at", "is_acknowledged", "details"),
                [F.desc("detected_at"), F.col("detection_id")], 150, 5)


@query("flt5_threat_search", f"""
WITH {GRADED_SQL}
SELECT cve_id, title, description, severity, cvss_v3_score, is_exploited_in_wild FROM graded
WHERE cve_id ILIKE '%RING%' OR title ILIKE '%RING%' OR description ILIKE '%RING%'
ORDER BY cvss_v3_score DESC NULLS LAST, cve_id LIMIT 50""")
def _(t):
    rows = thr.search(graded(t), "RING").select(
        "cve_id", "title", "description", "severity", "cvss_v3_score", "is_exploited_in_wild")
    return page(rows, thr.search_order(), 50)


@query("flt5_indexed_search", f"""
WITH {GRADED_SQL}
SELECT DISTINCT term, cve_id, title, severity FROM graded, (SELECT unnest(['RING', 'st', '-0001', 'e b', '100%', 'zzzz']) AS term)
WHERE contains(lower(cve_id), lower(term)) OR contains(lower(title), lower(term)) OR contains(lower(description), lower(term))""")
def _(t):
    """Several terms against one stored index: common, too short for it, within the id, across words, and two that are nowhere."""
    index = TextIndex(t.spark, scratch_dir(t.spark, "flt5"), buckets=8)
    index.build(graded(t).select(*index.columns, "severity"))
    found = [index.search(term).select(F.lit(term).alias("term"), "cve_id", "title", "severity")
             for term in ("RING", "st", "-0001", "e b", "100%", "zzzz")]
    return reduce(DataFrame.unionByName, found).distinct()


@query("flt6_threat_by_id", "SELECT * FROM known_threats WHERE cve_id = 'CVE-2024-00042'")
def _(t):
    return thr.by_id(t.known_threats, "cve-2024-00042")


@query("flt7_suspicious_listeners", """
SELECT asset_id, organization_id, ip_address, open_port FROM assets
WHERE status = 'active' AND NOT is_server AND (22 > 1024 OR open_port > 1024)""")
def _(t):
    assets = t.assets.withColumn("open_ports", F.array(F.lit(22), F.col("open_port")))
    return inventory.suspicious_listeners(assets).select("asset_id", "organization_id", "ip_address", "open_port")


@query("flt8_licensed_and_ml_orgs", f"""
SELECT organization_id, name, features LIKE '%true%' AS ml_enabled FROM organizations
WHERE license_expires_at > {ORDER_SQL}""")
def _(t):
    paid = inventory.licensed(t.organizations, order_clock()).select("organization_id", "name")
    ml = inventory.ml_enabled(t.organizations, order_clock()).select("organization_id", F.lit(True).alias("m"))
    return paid.join(ml, "organization_id", "left").select(
        "organization_id", "name", F.coalesce("m", F.lit(False)).alias("ml_enabled"))


@query("flt9_se2_scan_ranges", """
SELECT o.organization_id, coalesce(s.network_segment, '192.168.0.0/16') AS network_segment
FROM organizations o LEFT JOIN (
  SELECT DISTINCT organization_id, '10.' || CAST(organization_id AS VARCHAR) || '.' ||
         split_part(ip_address, '.', 3) || '.0/24' AS network_segment
  FROM assets WHERE is_server AND organization_id % 6 <> 5) s ON s.organization_id = o.organization_id""")
def _(t):
    segment = F.concat(F.lit("10."), F.col("organization_id").cast("string"), F.lit("."),
                       F.split("ip_address", r"\.")[2], F.lit(".0/24"))
    assets = t.assets.withColumn(
        "network_segment", F.when(F.col("is_server") & (F.col("organization_id") % 6 != 5), segment))
    return inventory.scan_ranges(assets, t.organizations)


@query("jn1_ag6_asset_exposure", """
SELECT a.asset_id, a.organization_id, a.ip_address,
       (SELECT count(DISTINCT v.vulnerability_id) FROM asset_vulnerabilities v
         WHERE v.asset_id = a.asset_id AND v.status = 'open') AS vulnerability_count,
       (SELECT count(DISTINCT d.detection_id) FROM anomaly_detections d
         WHERE d.asset_id = a.asset_id AND NOT d.is_acknowledged) AS anomaly_count
FROM assets a""")
def _(t):
    return inventory.exposure_counts(t.assets, t.asset_vulnerabilities, t.anomaly_detections).select(
        "asset_id", "organization_id", "ip_address", "vulnerability_count", "anomaly_count")


@query("jn2_vulnerabilities_with_threats", f"""
WITH {GRADED_SQL}
SELECT v.vulnerability_id, v.asset_id, k.cve_id, k.severity, k.cvss_v3_score
FROM asset_vulnerabilities v JOIN graded k ON k.threat_id = v.threat_id""")
def _(t):
    return vuln.with_threats(t.asset_vulnerabilities, graded(t)).select(
        "vulnerability_id", "asset_id", "cve_id", "severity", "cvss_v3_score")


@query("jn3_live_remediation_flag", """
SELECT v.vulnerability_id, v.asset_id, EXISTS (
  SELECT 1 FROM remediation_tasks r JOIN lineitem l ON l.l_orderkey = r.task_id
  WHERE r.asset_id * 1000000 + l.l_partkey = v.vulnerability_id
    AND r.status IN ('pending_approval', 'approved', 'in_progress')) AS remediation_available
FROM asset_vulnerabilities v""")
def _(t):
    return vuln.flag_live_remediation(t.asset_vulnerabilities, vuln_tasks(t)).select(
        "vulnerability_id", "asset_id", "remediation_available")


@query("jn4_tasks_with_assets", """
SELECT t.task_id, t.asset_id, t.requested_at, t.risk_level, t.status, a.hostname, a.ip_address
FROM remediation_tasks t JOIN assets a ON a.asset_id = t.asset_id WHERE t.status = 'pending_approval'
ORDER BY t.requested_at DESC, t.task_id LIMIT 100""")
def _(t):
    found, _ = inventory.split_by_asset(
        t.remediation_tasks.filter(F.col("status") == "pending_approval"), t.assets)
    return page(found.select("task_id", "asset_id", "requested_at", "risk_level", "status", "hostname", "ip_address"),
                [F.desc("requested_at"), F.col("task_id")], 100)


@query("jn8_task_asset_lookup", """
SELECT t.task_id, t.asset_id, a.ip_address,
       CASE WHEN a.asset_id IS NULL THEN 'asset_not_found' END AS reject_reason
FROM remediation_tasks t LEFT JOIN (SELECT * FROM assets WHERE status <> 'inactive') a ON a.asset_id = t.asset_id""")
def _(t):
    known = t.assets.filter(F.col("status") != "inactive")
    found, lost = inventory.split_by_asset(t.remediation_tasks, known)
    cols = ["task_id", "asset_id", "ip_address", "reject_reason"]
    return (found.withColumn("reject_reason", F.lit(None).cast("string")).select(*cols)
            .union(lost.withColumn("ip_address", F.lit(None).cast("string")).select(*cols)))


@query("jn10_insert_missing_associations", """
SELECT DISTINCT o.o_custkey AS asset_id, l.l_partkey AS threat_id
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
WHERE NOT EXISTS (SELECT 1 FROM asset_vulnerabilities v
                  WHERE v.asset_id = o.o_custkey AND v.threat_id = l.l_partkey AND v.status = 'open')""")
def _(t):
    batch = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("asset_id"), F.col("l_partkey").alias("threat_id"))
    existing = t.asset_vulnerabilities.filter(F.col("status") == "open")
    return insert_missing(batch, existing, ["asset_id", "threat_id"])


@query("jn11_mark_listed_rows", """
SELECT e.event_id, d.detection_id IS NOT NULL AS archived,
       CASE WHEN d.detection_id IS NOT NULL THEN 'archive/' || d.severity ELSE e.event_type END AS pointer
FROM events e LEFT JOIN anomaly_detections d ON d.detection_id = e.event_id AND d.is_acknowledged""")
def _(t):
    listed = t.anomaly_detections.filter("is_acknowledged").select(
        F.col("detection_id").alias("event_id"), F.concat(F.lit("archive/"), F.col("severity")).alias("pointer"))
    rows = t.events.select("event_id", F.col("event_type").alias("pointer"))
    marked = set_where_listed(rows, listed, "event_id", "pointer")
    return marked.select("event_id", F.col("pointer").startswith("archive/").alias("archived"), "pointer")


@query("ag1_open_by_severity", f"""
WITH {GRADED_SQL}, {SCOPED_SQL},
g AS (SELECT v.organization_id, k.severity, count(*) AS open_count,
             count(*) FILTER (WHERE v.is_exploitable) AS exploitable_count,
             round(avg(k.cvss_v3_score), 6) AS avg_cvss
      FROM scoped v JOIN graded k ON k.threat_id = v.threat_id WHERE v.status = 'open' GROUP BY ALL)
SELECT organization_id, severity, {RANK_SQL} AS severity_rank, open_count, exploitable_count, avg_cvss,
       CAST(sum(open_count) OVER (PARTITION BY organization_id) AS BIGINT) AS total_open
FROM g""")
def open_by_severity(t):
    return (vuln.open_by_severity(scoped_vulns(t), graded(t))
            .withColumn("avg_cvss", F.round("avg_cvss", 6)).orderBy("organization_id", "severity_rank"))


@query("ag2_anomalies_by_type_severity", f"""
SELECT organization_id, anomaly_type, severity, count(*) AS detections,
       count(*) FILTER (WHERE is_false_positive) AS false_positives,
       round(avg(confidence_score), 6) AS avg_confidence
FROM anomaly_detections WHERE detected_at > {EVENT_SQL} - INTERVAL 7 DAYS GROUP BY ALL""")
def _(t):
    rows = anom.by_type_and_severity(anom.recent(t.anomaly_detections, event_clock(), 7))
    return rows.withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("ag3_hourly_timeline", f"""
SELECT organization_id, date_trunc('hour', detected_at) AS hour, count(*) AS detections,
       round(avg(confidence_score), 6) AS avg_confidence
FROM anomaly_detections WHERE detected_at > {EVENT_SQL} - INTERVAL 30 DAYS GROUP BY ALL""")
def _(t):
    rows = anom.hourly_timeline(anom.recent(t.anomaly_detections, event_clock(), 30))
    return rows.select("organization_id", F.col("hour").cast("timestamp_ntz").alias("hour"), "detections",
                       F.round("avg_confidence", 6).alias("avg_confidence"))


@query("ag4_threat_totals", f"""
WITH {GRADED_SQL}, dated AS (
  SELECT g.*, {ORDER_SQL} + INTERVAL 1 DAY * CAST(threat_id % 90 - 45 AS INT) AS cisa_due_date,
         {ORDER_SQL} - INTERVAL 1 HOUR * CAST(threat_id AS INT) AS updated_at FROM graded g)
SELECT count(*) AS total_cves, count(*) FILTER (WHERE is_exploited_in_wild) AS exploited_count,
       count(*) FILTER (WHERE severity = 'critical') AS critical_count,
       count(*) FILTER (WHERE severity = 'high') AS high_count,
       count(*) FILTER (WHERE cisa_due_date > {ORDER_SQL}) AS pending_kev_count, max(updated_at) AS last_update
FROM dated""")
def _(t):
    return thr.totals(dated_threats(t), order_clock())


def dated_threats(t):
    """Threats with deadlines around the clock and staggered update times."""
    return (graded(t)
            .withColumn("cisa_due_date", order_clock() + F.make_interval(
                days=(F.col("threat_id") % 90 - 45).cast("int")))
            .withColumn("updated_at", order_clock() - F.make_interval(hours=F.col("threat_id").cast("int"))))


@query("src4_sync_bookmark", f"""
SELECT source, max({ORDER_SQL} - INTERVAL 1 HOUR * CAST(threat_id AS INT)) AS last_sync
FROM known_threats GROUP BY source""")
def _(t):
    return thr.sync_bookmark(dated_threats(t))


@query("ag5_organisation_dashboard", f"""
WITH {SCOPED_SQL}
SELECT o.organization_id,
  (SELECT count(*) FROM assets x WHERE x.organization_id = o.organization_id) AS total_assets,
  (SELECT count(*) FROM assets x WHERE x.organization_id = o.organization_id AND x.status = 'active') AS active_assets,
  (SELECT count(*) FROM scoped x WHERE x.organization_id = o.organization_id AND x.status = 'open')
    AS open_vulnerabilities,
  (SELECT count(*) FROM anomaly_detections x WHERE x.organization_id = o.organization_id
     AND NOT x.is_acknowledged) AS unacked_anomalies,
  (SELECT count(*) FROM remediation_tasks r JOIN assets x ON x.asset_id = r.asset_id
    WHERE x.organization_id = o.organization_id AND r.status = 'pending_approval') AS pending_remediations
FROM (SELECT DISTINCT organization_id FROM assets
      UNION SELECT DISTINCT organization_id FROM anomaly_detections) o""")
def dashboard_counts(t):
    return dashboard.organisation_counts(t.assets, scoped_vulns(t), t.anomaly_detections, scoped_tasks(t))


@query("ag7_false_positive_share", f"""
SELECT organization_id, count(*) AS detections, count(*) FILTER (WHERE is_false_positive) AS false_positives,
       CASE WHEN count(*) > 100 THEN
            round(CAST(count(*) FILTER (WHERE is_false_positive) AS DOUBLE) / count(*), 6) END AS false_positive_share
FROM anomaly_detections WHERE detected_at > {EVENT_SQL} - INTERVAL 7 DAYS GROUP BY organization_id""")
def _(t):
    return anom.false_positive_share(t.anomaly_detections, event_clock()).withColumn(
        "false_positive_share", F.round("false_positive_share", 6))


@query("so3_severity_rank", f"""
WITH {GRADED_SQL}
SELECT severity, {RANK_SQL} AS severity_rank, count(*) AS threats FROM graded GROUP BY ALL""")
def _(t):
    return (graded(t).groupBy("severity").agg(F.count("*").alias("threats"))
            .withColumn("severity_rank", severity_rank(F.col("severity"))).orderBy("severity_rank"))


@query("wn1_top_threats_per_type", """
SELECT p_type, cve_id, cvss_v3_score FROM (
  SELECT p.p_type, k.cve_id, k.cvss_v3_score, row_number() OVER (
    PARTITION BY p.p_type ORDER BY k.cvss_v3_score DESC NULLS LAST, k.cve_id) AS rn
  FROM known_threats k JOIN part p ON p.p_partkey = k.threat_id) WHERE rn <= 10""")
def _(t):
    rows = t.known_threats.join(t.part, F.col("threat_id") == F.col("p_partkey")).select(
        "p_type", "cve_id", "cvss_v3_score")
    return top_per_group(rows, ["p_type"], [F.desc_nulls_last("cvss_v3_score"), F.col("cve_id")], 10)


@query("wn3_oldest_audit_rows", f"""
SELECT organization_id, event_id, ts FROM (
  SELECT user_id % 25 AS organization_id, event_id, ts,
         row_number() OVER (PARTITION BY user_id % 25 ORDER BY ts, event_id) AS rn
  FROM events WHERE ts < {EVENT_SQL} - INTERVAL 10 DAYS) WHERE rn <= 10000""")
def _(t):
    old = t.events.filter(F.col("ts") < event_clock() - F.make_interval(days=F.lit(10))).select(
        (F.col("user_id") % 25).alias("organization_id"), "event_id", "ts")
    return top_per_group(old, ["organization_id"], [F.col("ts"), F.col("event_id")], 10000)


@query("wn4_last_write_per_key", """
SELECT user_id, ts, event_id, value FROM (
  SELECT user_id, ts, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1""")
def _(t):
    return latest_per_key(t.events.select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"])


@query("fn1_severity_from_scores", f"SELECT threat_id, {SEVERITY_SQL} AS severity FROM known_threats")
def _(t):
    return graded(t).select("threat_id", "severity")


@query("fn2_severity_from_confidence", """
SELECT detection_id, CASE WHEN c >= 0.9 THEN 'critical' WHEN c >= 0.75 THEN 'high' WHEN c >= 0.5 THEN 'medium'
       WHEN c >= 0.3 THEN 'low' ELSE 'informational' END AS graded
FROM (SELECT detection_id, CASE anomaly_type
        WHEN 'dos_loop' THEN least(1.0, confidence_score * CAST(1.2 AS DOUBLE))
        WHEN 'backdoor_connection' THEN least(1.0, confidence_score * CAST(1.3 AS DOUBLE))
        ELSE confidence_score END AS c FROM anomaly_detections)""")
def _(t):
    return t.anomaly_detections.select("detection_id", severity_from_confidence(
        F.col("confidence_score"), F.col("anomaly_type")).alias("graded"))


@query("fn5_server_flag", """
SELECT event_id, (dst_port IN (22,23,25,53,80,110,143,443,445,465,587,993,995,1433,1521,3306,3389,5432,5900,6379,
        8080,8443,27017) OR protocol IN (22)) AS is_server FROM flow_events""")
def _(t):
    return t.flow_events.select("event_id", has_server_port(F.array("dst_port", "protocol")).alias("is_server"))


@query("fn6_packet_count", """
SELECT event_id, CAST(trunc(bytes / 7 * 1.5) AS BIGINT) AS packets FROM flow_events""")
def _(t):
    return t.flow_events.select("event_id", integer_packets(F.col("bytes") / 7, F.lit(1.5)).alias("packets"))


@query("fn10_inverted_score", """
SELECT event_id, round(1 - greatest(0, least(1, value / 250 - 1 + 0.5)), 9) AS score FROM events""")
def _(t):
    return t.events.select("event_id", F.round(invert_score(F.col("value") / 250 - 1), 9).alias("score"))


@query("fn11_json_access", """
SELECT event_id, json_extract_string(props, '$.k') AS k FROM events""")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"))
