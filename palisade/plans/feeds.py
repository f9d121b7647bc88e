"""Feed ingest, inventory upserts and correlation, on files that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palisade.functions.net import address, canonical_ip, parse_cidr
from palisade.functions.parsing import parse_date, parse_timestamp
from palisade.functions.severity import severity_from_scores
from palisade.functions.software import is_outdated
from palisade.functions.text import render_template
from palisade.operators import allowlist, inventory, scan_jobs, threats as thr, vulnerabilities as vuln
from palisade.operators.merging import action_counts
from palisade.plans.reads import ORDER_SQL, SEVERITY_SQL, order_clock
from palisade.plans.registry import query
from palisade.schemas import ASSETS, THREATS, struct_of
from palisade.session import scratch_dir
from palisade.sources import feeds, scans

PAGE_ROWS = 2000


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Columns of a table schema, absent ones null."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in struct_of(ddl)])


def paged(t, rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by their feed page, so that tasks make the records where the page is written.

    A record is far larger than its row: made before, a file of one split makes all of them in one task.
    """
    tasks = max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), 4 * t.spark.sparkContext.defaultParallelism)
    return rows.withColumn("page", F.floor(F.col(key) / PAGE_ROWS)).repartition(tasks, "page")


def land_pages(t, records: DataFrame, label: str, path: str | None = None) -> str:
    """Write records (page, record) as feed pages, one compressed JSON document of at most 2000 records per file."""
    path = path or scratch_dir(t.spark, label)
    pages = records.groupBy("page").agg(F.collect_list("record").alias("vulnerabilities"))
    body = pages.select("page", F.to_json(F.struct("vulnerabilities")).alias("value"))
    body.write.partitionBy("page").option("compression", "gzip").text(path)
    return path


def nvd_feed(t) -> DataFrame:
    """Every part as one advisory, with the awkward shapes a feed has."""
    sizes = t.part.select(F.col("p_partkey").alias("threat_id"), "p_size").hint("merge")
    p = paged(t, t.known_threats.join(sizes, "threat_id"), "threat_id")
    k = F.col("threat_id")
    metric = "array<struct<cvssData:struct<baseScore:double,vectorString:string>>>"

    def score(value):
        return F.array(F.struct(F.struct(value.alias("baseScore"), F.lit("AV:N").alias("vectorString")).alias(
            "cvssData")))

    none = F.lit(None).cast(metric)
    record = F.struct(F.struct(
        F.col("cve_id").alias("id"),
        F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"),
                 F.lit("T10:15:00.000")).alias("published"),
        F.when(k % 13 == 0, "not a date").otherwise(
            F.concat(F.lit("2024-02-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("T08:00:00Z"))
        ).alias("lastModified"),
        F.when(k % 5 == 0, F.array(F.struct(F.lit("de").alias("lang"), F.col("title").alias("value")))).otherwise(
            F.array(F.struct(F.lit("de").alias("lang"), F.col("title").alias("value")),
                    F.struct(F.lit("en").alias("lang"), F.col("description").alias("value")))).alias("descriptions"),
        F.struct(
            F.when(F.col("cvss_v3_score").isNotNull() & (k % 3 == 0), score(F.col("cvss_v3_score"))).otherwise(none)
            .alias("cvssMetricV31"),
            F.when(F.col("cvss_v3_score").isNotNull() & (k % 2 == 0), score(F.col("cvss_v3_score") / 2)).otherwise(none)
            .alias("cvssMetricV30"),
            F.when(F.col("cvss_v2_score").isNotNull(), score(F.col("cvss_v2_score"))).otherwise(none)
            .alias("cvssMetricV2")).alias("metrics"),
        F.array(F.struct(F.array(F.struct(F.transform(
            F.sequence(F.lit(1), F.col("p_size") * 5),
            lambda i: F.struct((i % 2 == 1).alias("vulnerable"),
                               F.concat(F.lit("cpe:2.3:a:v:item"), i.cast("string")).alias("criteria"))
        ).alias("cpeMatch"))).alias("nodes"))).alias("configurations"),
        F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda i: F.struct(
            F.concat(F.lit("https://x.example/"), i.cast("string")).alias("url"),
            F.when(i % 3 == 0, F.array(F.lit("Patch"))).otherwise(F.array(F.lit("Exploit"), F.lit("Patch")))
            .alias("tags"))).alias("references"),
    ).alias("cve"))
    return p.select("threat_id", "page", record.alias("record"))


def kev_feed(t) -> DataFrame:
    """The exploited parts as catalogue entries; some lack a vendor or have a broken date."""
    k = F.col("threat_id")
    return paged(t, t.known_threats.filter("is_exploited_in_wild"), "threat_id").select("page", F.struct(
        F.col("cve_id").alias("cveID"), F.col("title").alias("vulnerabilityName"),
        F.col("description").alias("shortDescription"),
        F.when(k % 4 == 0, "soon").otherwise(F.concat(F.lit("2001-12-"), (k % 28 + 1).cast("string"))).alias("dateAdded"),
        F.concat(F.lit("2002-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0")).alias("dueDate"),
        F.lit("patch").alias("requiredAction"),
        F.when(k % 3 == 0, "").otherwise("vendor").alias("vendorProject"), F.col("title").alias("product"),
    ).alias("record"))


def nvd_records(t) -> DataFrame:
    return feeds.read_nvd(t.spark, land_pages(t, nvd_feed(t), "nvd"))


def kev_records(t) -> DataFrame:
    return feeds.read_kev(t.spark, land_pages(t, kev_feed(t), "kev"))


NVD_V3 = """CASE WHEN cvss_v3_score IS NULL THEN NULL WHEN threat_id % 3 = 0 THEN cvss_v3_score
     WHEN threat_id % 2 = 0 THEN cvss_v3_score / 2 END"""
NVD_SQL = f"""nvd AS (SELECT cve_id, threat_id, p_size, CASE WHEN threat_id % 5 = 0 THEN title ELSE description END AS description,
  {NVD_V3} AS cvss_v3_score, cvss_v2_score,
  TIMESTAMP '2024-01-01 10:15:00' + INTERVAL 1 DAY * CAST(threat_id % 28 AS INT) AS published_at,
  CASE WHEN threat_id % 13 <> 0 THEN TIMESTAMP '2024-02-01 08:00:00' + INTERVAL 1 DAY * CAST(threat_id % 28 AS INT)
       END AS last_modified_at
  FROM known_threats JOIN part ON p_partkey = threat_id)"""


NVD_RECORDS_SQL = f"""
WITH {NVD_SQL}
SELECT cve_id, description, cvss_v3_score, cvss_v2_score, {SEVERITY_SQL} AS severity,
       (p_size * 5 + 1) // 2 AS cpes, 'cpe:2.3:a:v:item1' AS first_cpe,
       p_size - p_size // 3 AS exploit_refs, published_at, last_modified_at
FROM nvd"""


@query("src1_nvd_records", NVD_RECORDS_SQL)
@query("src1_nvd_records_all", NVD_RECORDS_SQL)
def _(t):
    return _nvd_columns(nvd_records(t))


def _nvd_columns(records: DataFrame) -> DataFrame:
    return records.select(
        "cve_id", "description", "cvss_v3_score", "cvss_v2_score", "severity", F.size("cpe_matches").alias("cpes"),
        F.col("cpe_matches")[0].alias("first_cpe"), F.size("exploit_references").alias("exploit_refs"),
        F.col("published_at").cast("timestamp_ntz").alias("published_at"),
        F.col("last_modified_at").cast("timestamp_ntz").alias("last_modified_at"))


@query("src2_kev_records", """
SELECT cve_id, title, description, 'critical' AS severity, TRUE AS is_exploited_in_wild,
       CASE WHEN threat_id % 4 <> 0 THEN DATE '2001-12-01' + CAST(threat_id % 28 AS INT) END AS cisa_kev_added_at,
       DATE '2002-01-01' + CAST(threat_id % 28 AS INT) AS cisa_due_date, 'patch' AS cisa_required_action,
       CASE WHEN threat_id % 3 <> 0 THEN 'vendor' END AS vendor
FROM known_threats WHERE is_exploited_in_wild""")
def _(t):
    return kev_records(t).select(
        "cve_id", "title", "description", "severity", "is_exploited_in_wild", "cisa_kev_added_at", "cisa_due_date",
        "cisa_required_action", F.col("affected_products")[0]["vendor"].alias("vendor"))


@query("src3_feed_slice", f"""
WITH {NVD_SQL}
SELECT cve_id, last_modified_at FROM nvd
WHERE last_modified_at BETWEEN TIMESTAMP '2024-02-05 00:00:00' AND TIMESTAMP '2024-02-20 08:00:00'""")
def _(t):
    stamp = [F.to_timestamp(F.lit(x)) for x in ("2024-02-05 00:00:00", "2024-02-20 08:00:00")]
    return feeds.modified_between(nvd_records(t), *stamp).select(
        "cve_id", F.col("last_modified_at").cast("timestamp_ntz").alias("last_modified_at"))


def stored_threats(t) -> DataFrame:
    """What the catalogue holds before a sync."""
    rows = (t.known_threats.filter(F.col("source") == "cisa_kev")
            .withColumn("severity", severity_from_scores(F.col("cvss_v3_score"), F.col("cvss_v2_score")))
            .withColumn("is_exploited_in_wild", F.lit(False)))
    return conform(rows, THREATS)


def full_sync(t) -> tuple[DataFrame, DataFrame]:
    """The exploited catalogue first, then the advisories."""
    clock = F.to_timestamp(F.lit("2024-01-31 00:00:00"))
    kev = thr.apply_kev(stored_threats(t), thr.last_in_batch(kev_records(t)), clock)
    nvd = thr.apply_nvd(kev.drop("action"), thr.last_in_batch(nvd_records(t)), clock)
    return kev, nvd


@query("ups2_ups3_ups4_threat_sync", f"""
WITH {NVD_SQL}, graded AS (SELECT *, {SEVERITY_SQL} AS severity FROM nvd)
SELECT k.cve_id, k.cve_id AS title, g.description, g.severity,
       CASE WHEN k.source = 'cisa_kev' OR NOT k.is_exploited_in_wild THEN k.source ELSE 'cisa_kev' END AS source,
       k.is_exploited_in_wild,
       CAST(round(coalesce(g.cvss_v3_score, CASE WHEN k.source = 'cisa_kev' THEN k.cvss_v3_score END), 4) AS DECIMAL(6,4))
         AS cvss_v3_score,
       CASE WHEN k.is_exploited_in_wild THEN DATE '2002-01-01' + CAST(k.threat_id % 28 AS INT) END AS cisa_due_date,
       CASE WHEN k.source = 'cisa_kev' OR k.is_exploited_in_wild THEN 'updated' ELSE 'new' END AS action
FROM known_threats k JOIN graded g ON g.cve_id = k.cve_id""")
def _(t):
    _, merged = full_sync(t)
    return merged.select("cve_id", "title", "description", "severity", "source", "is_exploited_in_wild",
                         F.col("cvss_v3_score").cast("decimal(6,4)").alias("cvss_v3_score"), "cisa_due_date", "action")


@query("ag10_sync_counts", """
SELECT 'cisa_kev' AS feed, count(*) FILTER (WHERE is_exploited_in_wild AND source = 'nist_nvd') AS new_count,
       count(*) FILTER (WHERE is_exploited_in_wild AND source = 'cisa_kev') AS updated_count FROM known_threats
UNION ALL
SELECT 'nist_nvd', count(*) FILTER (WHERE source = 'nist_nvd' AND NOT is_exploited_in_wild),
       count(*) FILTER (WHERE source = 'cisa_kev' OR is_exploited_in_wild) FROM known_threats""")
def _(t):
    kev, nvd = full_sync(t)
    return (action_counts(kev).withColumn("feed", F.lit("cisa_kev"))
            .union(action_counts(nvd).withColumn("feed", F.lit("nist_nvd"))))


@query("fn3_tolerant_dates", """
SELECT o_orderkey,
  CASE o_orderkey % 4 WHEN 0 THEN o_orderdate WHEN 1 THEN date_trunc('day', o_orderdate) END AS stamp,
  CASE WHEN o_orderkey % 4 = 1 THEN CAST(o_orderdate AS DATE) END AS day
FROM orders""")
def _(t):
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    text = (F.when(k == 0, F.concat(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
            .when(k == 1, F.date_format(d, "yyyy-MM-dd")).when(k == 2, F.date_format(d, "dd/MM/yyyy"))
            .otherwise("2024-13-45"))
    rows = t.orders.select("o_orderkey", text.alias("x"))
    return rows.select("o_orderkey", parse_timestamp(F.col("x")).cast("timestamp_ntz").alias("stamp"),
                       parse_date(F.col("x")).alias("day"))


# --- scan reports and inventory -------------------------------------------------------------

def scan_reports(t) -> DataFrame:
    """One report per customer host, in the nested form the scanner writes."""
    k = F.col("asset_id")
    port = "struct<state:string,name:string,product:string,version:string,extrainfo:string>"

    def entry(state, name, product, version):
        return F.struct(state.alias("state"), F.lit(name).alias("name"), product.alias("product"),
                        version.alias("version"), F.lit("").alias("extrainfo"))

    state = F.when(k % 4 == 0, "closed").otherwise("open")
    # three out of four hosts are known; the rest moved to a new address
    ip = F.when(k % 4 == 3, F.concat(F.lit("172.16."), F.split("ip_address", r"\.")[2], F.lit("."),
                                     F.split("ip_address", r"\.")[3])).otherwise(F.col("ip_address"))
    return t.assets.select(
        "organization_id", F.concat(F.lit("scan-"), F.col("organization_id").cast("string")).alias("scan_id"),
        ip.alias("ip_address"),
        F.struct(F.when(k % 2 == 0, F.concat(F.lit("AA:BB:CC:00:00:"), F.lpad((k % 90 + 10).cast("string"), 2, "0")))
                 .alias("mac")).alias("addresses"),
        F.when(k % 3 == 0, F.array(F.struct(F.concat(F.lit("new-"), F.col("hostname")).alias("name")))).alias("hostnames"),
        F.when(k % 5 == 0, F.array(F.struct(
            F.lit("Linux 5").alias("name"), F.lit("97").alias("accuracy"),
            F.array(F.struct(F.lit("Linux").alias("osfamily"))).alias("osclass")))).alias("osmatch"),
        F.map_from_arrays(
            F.array(F.col("open_port").cast("string"), F.lit("9000")),
            F.array(entry(state, "svc", F.lit("OpenSSH"), F.lit("7.4")),
                    entry(F.lit("open"), "alt", F.lit("nginx"), F.lit("1.25")))).alias("tcp"),
        F.when(k % 6 == 0, F.create_map(F.lit("53"), entry(F.lit("open"), "domain", F.lit("bind"), F.lit("9"))))
        .cast(f"map<string,{port}>").alias("udp"))


def findings(t) -> DataFrame:
    path = scratch_dir(t.spark, "scans")
    scan_reports(t).write.json(path)
    return scans.normalise(scans.read_reports(t.spark, path))


@query("src5_scan_findings", """
SELECT organization_id,
  CASE WHEN asset_id % 4 = 3 THEN '172.16.' || split_part(ip_address, '.', 3) || '.' || split_part(ip_address, '.', 4)
       ELSE ip_address END AS ip_address,
  CASE WHEN asset_id % 2 = 0 THEN 'aa:bb:cc:00:00:' || CAST(asset_id % 90 + 10 AS VARCHAR) END AS mac_address,
  CASE WHEN asset_id % 3 = 0 THEN 'new-' || hostname END AS hostname,
  CASE WHEN asset_id % 5 = 0 THEN 'Linux' END AS os_family, CASE WHEN asset_id % 5 = 0 THEN 97 END AS os_accuracy,
  1 + CAST(asset_id % 4 <> 0 AS INT) + CAST(asset_id % 6 = 0 AS INT) AS services,
  CAST(9000 + CASE WHEN asset_id % 4 <> 0 THEN open_port ELSE 0 END + CASE WHEN asset_id % 6 = 0 THEN 53 ELSE 0 END
       AS BIGINT) AS port_sum,
  (asset_id % 6 = 0 OR (asset_id % 4 <> 0 AND open_port = 22)) AS is_server
FROM assets""")
def _(t):
    return findings(t).select(
        "organization_id", "ip_address", "mac_address", "hostname", "os_family", "os_accuracy",
        F.size("services").alias("services"),
        F.aggregate("open_ports", F.lit(0).cast("bigint"), lambda a, p: a + p).alias("port_sum"), "is_server")


def stored_assets(t) -> DataFrame:
    rows = (t.assets.withColumn("mac_address", F.lit("00:00:00:00:00:01"))
            .withColumn("open_ports", F.array("open_port"))
            .withColumn("updated_at", F.to_timestamp(F.lit("2001-01-01 00:00:00"))))
    return conform(rows, ASSETS)


UPSERT_SQL = """up AS (
  SELECT a.asset_id, a.organization_id, a.ip_address, a.hostname, a.status, FALSE AS fresh FROM assets a
  UNION ALL
  SELECT NULL, organization_id, '172.16.' || split_part(ip_address, '.', 3) || '.' || split_part(ip_address, '.', 4),
         CASE WHEN asset_id % 3 = 0 THEN 'new-' || hostname END, 'active', TRUE FROM assets WHERE asset_id % 4 = 3)"""


@query("ups1_asset_upsert", f"""
WITH {UPSERT_SQL}
SELECT asset_id, organization_id, ip_address,
  CASE WHEN NOT fresh AND asset_id % 4 <> 3 AND asset_id % 3 = 0 THEN 'new-' || hostname ELSE hostname END AS hostname,
  CASE WHEN NOT fresh AND asset_id % 4 <> 3 THEN 'active' ELSE status END AS status,
  CASE WHEN fresh THEN 'new' WHEN asset_id % 4 <> 3 THEN 'updated' ELSE 'kept' END AS action
FROM up""")
def _(t):
    merged = inventory.upsert_assets(stored_assets(t), findings(t), F.to_timestamp(F.lit("2002-01-01 00:00:00")))
    return merged.select("asset_id", "organization_id", "ip_address", "hostname", "status", "action")


@query("jn9_upsert_counts_per_org", """
SELECT organization_id, count(*) FILTER (WHERE asset_id % 4 = 3) AS new_count,
       count(*) FILTER (WHERE asset_id % 4 <> 3) AS updated_count
FROM assets GROUP BY organization_id""")
def _(t):
    merged = inventory.upsert_assets(stored_assets(t), findings(t), F.to_timestamp(F.lit("2002-01-01 00:00:00")))
    return action_counts(merged, ["organization_id"])


@query("upd1_quarantine", f"""
SELECT a.asset_id, a.organization_id,
       CASE WHEN d.asset_id IS NOT NULL THEN 'quarantined' ELSE a.status END AS status,
       CASE WHEN d.asset_id IS NOT NULL THEN {ORDER_SQL} END AS updated_at
FROM assets a LEFT JOIN (SELECT DISTINCT asset_id FROM anomaly_detections WHERE severity = 'critical') d
  ON d.asset_id = a.asset_id""")
def _(t):
    hot = t.anomaly_detections.filter(F.col("severity") == "critical").select("asset_id").distinct()
    commands = t.assets.join(hot, "asset_id", "left_semi").select("organization_id", "asset_id")
    assets = t.assets.withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    return inventory.quarantine(assets, commands, order_clock()).select(
        "asset_id", "organization_id", "status", "updated_at")


WORDS = ("OpenSSH", "nginx", "MySQL", "PostgreSQL", "Apache httpd")
VERSIONS = ("7.4", "nginx/1.10", "5.5", "9.6", "Apache/2.2")


def installed_services(t) -> DataFrame:
    """One service per order on the ordering customer's host; products range from bare names to specific ones."""
    k = F.col("o_orderkey")
    pick = [F.element_at(F.array(*[F.lit(w) for w in xs]), (k % 5 + 1).cast("int")) for xs in (WORDS, VERSIONS)]
    names = t.part.select(F.col("p_partkey").alias("o_custkey"), "p_name").hint("merge")
    return t.orders.join(names, "o_custkey", "left").select(
        F.col("o_custkey").alias("asset_id"), k.alias("service_id"),
        F.when(k % 3 == 0, pick[0]).otherwise(F.concat_ws(" ", pick[0], "p_name")).alias("product"),
        F.when(k % 7 == 0, "").otherwise(pick[1]).alias("version"))


def worded_threats(t) -> DataFrame:
    """Threats whose text names software, some with platform criteria as well."""
    k = F.col("threat_id")
    word = F.element_at(F.array(*[F.lit(w) for w in WORDS]), (k % 5 + 1).cast("int"))
    cpe = F.concat(F.lit("cpe:2.3:a:vendor:"), F.lower(word), F.lit(":1.0"))
    return t.known_threats.select(
        "threat_id", "cve_id", "cvss_v3_score",
        F.concat(F.lit("Flaw in "), word, F.lit(" "), "title", F.lit(" server")).alias("description"),
        F.when(k % 9 == 0, F.array(cpe)).alias("cpe_matches"))


SERVICES_SQL = """services AS (
  SELECT o_custkey AS asset_id, o_orderkey AS service_id,
    CASE WHEN o_orderkey % 3 = 0 OR p_name IS NULL THEN w ELSE w || ' ' || p_name END AS product,
    CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE v END AS version
  FROM (SELECT o.*, p.p_name,
      ['OpenSSH', 'nginx', 'MySQL', 'PostgreSQL', 'Apache httpd'][CAST(o_orderkey % 5 + 1 AS INT)] AS w,
      ['7.4', 'nginx/1.10', '5.5', '9.6', 'Apache/2.2'][CAST(o_orderkey % 5 + 1 AS INT)] AS v
    FROM orders o LEFT JOIN part p ON p.p_partkey = o.o_custkey)),
outdated AS (SELECT *, lower(product) AS product_key FROM services WHERE version <> '' AND (
  (contains(lower(product), 'openssh') AND regexp_matches(product || ' ' || version, '(?i)OpenSSH[_\\s]([0-7]\\.[0-9])')) OR
  (contains(lower(product), 'apache') AND regexp_matches(product || ' ' || version, '(?i)Apache/([12]\\.[0-4])')) OR
  (contains(lower(product), 'nginx') AND regexp_matches(product || ' ' || version, '(?i)nginx/([01]\\.[0-9]|1\\.[0-1][0-7])')) OR
  (contains(lower(product), 'mysql') AND regexp_matches(product || ' ' || version, '(?i)MySQL.*([0-4]\\.|5\\.[0-6])')) OR
  (contains(lower(product), 'postgresql') AND regexp_matches(product || ' ' || version, '(?i)PostgreSQL.*([0-9]\\.|1[0-2]\\.)')))),
worded AS (SELECT threat_id, cve_id, cvss_v3_score, 'Flaw in ' || w || ' ' || title || ' server' AS description,
    CASE WHEN threat_id % 9 = 0 THEN lower(w) END AS cpe_product
  FROM (SELECT *, ['OpenSSH', 'nginx', 'MySQL', 'PostgreSQL', 'Apache httpd'][CAST(threat_id % 5 + 1 AS INT)] AS w
        FROM known_threats))"""


@query("fn4_outdated_software", f"""
WITH {SERVICES_SQL}
SELECT s.service_id, o.service_id IS NOT NULL AS outdated FROM services s LEFT JOIN outdated o USING (service_id)""")
def _(t):
    return installed_services(t).select(
        "service_id", is_outdated(F.col("product"), F.col("version")).alias("outdated"))


CORRELATION_SQL = f"""
WITH {SERVICES_SQL},
pairs AS (SELECT p.product_key, w.threat_id, w.cve_id, row_number() OVER (PARTITION BY p.product_key
            ORDER BY w.cvss_v3_score DESC NULLS LAST, w.cve_id, w.threat_id) AS rn
  FROM (SELECT DISTINCT product_key FROM outdated) p JOIN worded w
    ON contains(lower(w.description), p.product_key) OR w.cpe_product = p.product_key)
SELECT o.asset_id, o.service_id, o.product_key AS affected_component, o.version AS installed_version,
       p.threat_id, p.cve_id
FROM outdated o JOIN pairs p ON p.product_key = o.product_key"""


@query("jn6_service_correlation", CORRELATION_SQL)
@query("jn6_service_correlation_all", CORRELATION_SQL)
def correlated(t, k: int | None = None):
    return vuln.correlate(installed_services(t), worded_threats(t), k).select(
        "asset_id", "service_id", "affected_component", "installed_version", "threat_id", "cve_id")


ASSOCIATIONS_SQL = f"""{SERVICES_SQL},
pairs AS (SELECT p.product_key, w.threat_id, row_number() OVER (PARTITION BY p.product_key
            ORDER BY w.cvss_v3_score DESC NULLS LAST, w.cve_id, w.threat_id) AS rn
  FROM (SELECT DISTINCT product_key FROM outdated) p JOIN worded w
    ON contains(lower(w.description), p.product_key) OR w.cpe_product = p.product_key),
found AS (SELECT o.asset_id, p.threat_id FROM outdated o JOIN pairs p ON p.product_key = o.product_key AND p.rn <= 10)"""


@query("jn10_association_counts", f"""
WITH {ASSOCIATIONS_SQL}
SELECT (SELECT count(*) FROM found) AS attempted, count(*) AS inserted FROM (
  SELECT DISTINCT asset_id, threat_id FROM found f WHERE NOT EXISTS (
    SELECT 1 FROM asset_vulnerabilities v WHERE v.asset_id = f.asset_id AND v.threat_id = f.threat_id))""")
def _(t):
    _, counts = vuln.associate(vuln.correlate(installed_services(t), worded_threats(t), k=10), t.asset_vulnerabilities)
    return counts


@query("ag9_scan_job_summary", f"""
WITH {ASSOCIATIONS_SQL},
errs AS (SELECT 'scan-' || CAST(user_id % 25 AS VARCHAR) AS scan_id, event_id, ts FROM events WHERE event_type = 'error'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY ts, event_id) AS rn FROM errs),
scan AS (SELECT 'scan-' || CAST(organization_id AS VARCHAR) AS scan_id, asset_id FROM assets)
SELECT s.scan_id, count(*) FILTER (WHERE asset_id % 4 = 3) AS assets_discovered,
  count(*) FILTER (WHERE asset_id % 4 <> 3) AS assets_updated,
  (SELECT count(*) FROM found f JOIN scan x ON x.asset_id = f.asset_id WHERE x.scan_id = s.scan_id) AS vulnerabilities_found,
  (SELECT count(*) FROM errs e WHERE e.scan_id = s.scan_id) AS errors_encountered,
  (SELECT string_agg('error ' || CAST(event_id AS VARCHAR), ';' ORDER BY rn) FROM ranked r
    WHERE r.scan_id = s.scan_id AND rn <= 10) AS first_errors
FROM scan s GROUP BY s.scan_id""")
def _(t):
    scan = F.concat(F.lit("scan-"), F.col("organization_id").cast("string"))
    merged = inventory.upsert_assets(stored_assets(t), findings(t), F.to_timestamp(F.lit("2002-01-01 00:00:00")))
    upserted = merged.filter(F.col("action") != "kept").select(scan.alias("scan_id"), "action")
    made = correlated(t, 10).join(t.assets.select("asset_id", "organization_id"), "asset_id").select(scan.alias("scan_id"))
    errors = t.events.filter(F.col("event_type") == "error").select(
        F.concat(F.lit("scan-"), (F.col("user_id") % 25).cast("string")).alias("scan_id"),
        F.struct("ts", "event_id").alias("seq"),
        F.concat(F.lit("error "), F.col("event_id").cast("string")).alias("message"))
    return scan_jobs.summarise(upserted, made, errors).withColumn("first_errors", F.array_join("first_errors", ";"))


def scan_history(t) -> DataFrame:
    """Orders as scan jobs; open ones have not ended."""
    start = F.col("o_orderdate")
    return t.orders.select(
        F.col("o_orderkey").alias("scan_id"), F.lit("network").alias("scan_type"),
        F.lower("o_orderpriority").alias("target_specification"), start.alias("started_at"),
        F.when(F.col("o_orderstatus") != "O", start + F.make_interval(secs=(F.col("o_orderkey") % 5000).cast("decimal(18,6)")))
        .alias("completed_at"),
        (F.col("o_custkey") % 25).alias("organization_id"), (F.col("o_custkey") % 7).alias("assets_discovered"),
        (F.col("o_custkey") % 11).alias("assets_updated"), (F.col("o_custkey") % 13).alias("vulnerabilities_found"),
        (F.col("o_custkey") % 3).alias("errors_encountered"))


@query("ag11_scan_duration", """
SELECT o_orderkey AS scan_id, CASE WHEN o_orderstatus <> 'O' THEN 'completed' ELSE 'failed' END AS status,
       CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderkey % 5000 AS DOUBLE) END AS duration_seconds
FROM orders""")
def _(t):
    return scan_jobs.with_outcome(scan_history(t)).select("scan_id", "status", "duration_seconds")


@query("flt10_scan_history", """
SELECT o_orderkey AS scan_id, 'network' AS scan_type, lower(o_orderpriority) AS target_specification,
  CASE WHEN o_orderstatus <> 'O' THEN 'completed' ELSE 'failed' END AS status, o_orderdate AS started_at,
  CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 1 SECOND * CAST(o_orderkey % 5000 AS INT) END AS completed_at,
  o_custkey % 7 AS assets_discovered, o_custkey % 11 AS assets_updated, o_custkey % 13 AS vulnerabilities_found,
  o_custkey % 3 AS errors_encountered
FROM orders WHERE o_custkey % 25 = 3 ORDER BY started_at DESC, scan_id LIMIT 50""")
def _(t):
    from palisade.operators.ranking import page

    rows = inventory.tenant_scope(scan_history(t), 3)
    return page(scan_jobs.history(scan_jobs.with_outcome(rows)), [F.desc("started_at"), F.col("scan_id")], 50)


IP_NUM = """(CAST(split_part({c}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({c}, '.', 2) AS BIGINT) * 65536
 + CAST(split_part({c}, '.', 3) AS BIGINT) * 256 + CAST(split_part({c}, '.', 4) AS BIGINT))"""
DST = IP_NUM.format(c="f.destination_ip")
NET = IP_NUM.format(c="split_part(r.ip_range, '/', 1)")
ALLOWED_SQL = f"""EXISTS (SELECT 1 FROM network_allowlists r
  WHERE r.organization_id = f.organization_id AND r.is_active AND r.direction IN ('outbound', 'both')
    AND (r.ip_address = f.destination_ip OR (r.ip_range IS NOT NULL
         AND {DST} >> (32 - CAST(split_part(r.ip_range, '/', 2) AS INT))
           = {NET} >> (32 - CAST(split_part(r.ip_range, '/', 2) AS INT))))
    AND (r.port_lo IS NULL OR (f.dst_port >= r.port_lo AND f.dst_port < r.port_hi)))"""


@query("jn5_allowlist_check", f"""
SELECT f.event_id, f.organization_id, f.destination_ip, f.dst_port, {ALLOWED_SQL} AS allowed FROM flow_events f""")
def _(t):
    return allowlist.check_flows(t.flow_events, t.network_allowlists).select(
        "event_id", "organization_id", "destination_ip", "dst_port", "allowed")


@query("jn7_source_assets", """
SELECT f.event_id, a.asset_id FROM flow_events f LEFT JOIN assets a
  ON a.organization_id = f.organization_id AND a.ip_address = f.source_ip""")
def _(t):
    return inventory.resolve_assets(t.flow_events, t.assets).select("event_id", "asset_id")


@query("net_address_keys", f"""
SELECT f.event_id, lower(lpad(to_hex({DST}), 32, '0')) AS ip_key, f.destination_ip AS canonical,
       lower(lpad(to_hex({DST} // 65536 * 65536), 32, '0')) AS network, 16 AS prefix
FROM flow_events f""")
def _(t):
    rows = t.flow_events.withColumn("c", parse_cidr("concat(destination_ip, '/16')"))
    return rows.select("event_id", address("destination_ip")["key"].alias("ip_key"),
                       canonical_ip("destination_ip").alias("canonical"), "c.network", "c.prefix")


@query("fn7_template_render", """
SELECT task_id, CASE WHEN task_id % 5 <> 0 THEN 'restart svc' || CAST(asset_id AS VARCHAR) || ' on ' || risk_level END
  AS script, CASE WHEN task_id % 5 = 0 THEN 'level' END AS missing FROM remediation_tasks""")
def _(t):
    params = F.map_filter(F.create_map(
        F.lit("name"), F.concat(F.lit("svc"), F.col("asset_id").cast("string")), F.lit("level"), F.col("risk_level")),
        lambda k, v: (k != "level") | (F.col("task_id") % 5 != 0))
    r = render_template(F.lit("restart {name} on {level}"), params)
    return t.remediation_tasks.select("task_id", r.alias("r")).select(
        "task_id", F.col("r.text").alias("script"), F.try_element_at("r.missing", F.lit(1)).alias("missing"))
