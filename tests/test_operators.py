import datetime as dt
import ipaddress
import json
import random

import pytest
from pyspark.sql import functions as F

from palisade.operators import allowlist, archive, inventory, merging, models, quality, ranking, redaction
from palisade.operators import remediation as rem, threats as thr, vulnerabilities as vuln
from palisade.plans.feeds import conform
from palisade.schemas import ASSETS, FINDING, KEV_DOCUMENT, NVD_DOCUMENT, THREATS
from palisade.sources import datasets, feeds, scans
from palisade.streaming import jobs

def now():
    return F.to_timestamp(F.lit("2024-02-01 00:00:00"))


def test_top_per_group_is_exact_with_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(5)}", rng.randrange(1000), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, v int, id int")
    got = {(r.g, r.id) for r in ranking.top_per_group(df, ["g"], [F.desc("v"), F.col("id")], 25, salts=7).collect()}
    want = set()
    for g in {r[0] for r in rows}:
        want |= {(g, r[2]) for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))[:25]}
    assert got == want


def brute_allowed(flow, rules, direction="outbound"):
    org, ip, port = flow
    try:
        addr = ipaddress.ip_address(ip)
    except ValueError:
        return False
    for o, rng, single, lo, hi, way, active in rules:
        if o != org or not active or way not in (direction, "both"):
            continue
        hit = False
        if single:
            hit = ipaddress.ip_address(single) == addr
        if rng and not hit:
            net = ipaddress.ip_network(rng, strict=False)
            hit = net.version == addr.version and net.prefixlen < net.max_prefixlen and addr in net
        if hit and (port is None or lo is None or lo <= port < hi):
            return True
    return False


def test_allowlist_matches_brute_force(spark):
    rng = random.Random(4)
    ranges = ["10.0.0.0/8", "10.1.0.0/16", "10.1.2.3/32", "2001:db8::/32", "2001:db8::/127", "0.0.0.0/0", "10.1.2.0/25", None]
    rules = []
    for i in range(60):
        lo = rng.choice([None, 80, 443, 1000])
        r = rng.choice(ranges)
        single = None if r and rng.random() < 0.8 else rng.choice(["10.1.2.3", "2001:db8::1", "8.8.8.8"])
        rules.append((rng.randrange(6), r, single, lo, None if lo is None else lo + rng.choice([1, 50, 2000]),
                      rng.choice(["outbound", "inbound", "both"]), rng.random() < 0.8))
    flows = [(rng.randrange(6), rng.choice(["10.1.2.3", "10.1.2.200", "10.9.9.9", "8.8.8.8", "2001:DB8:0::1", "2001:db8:1::",
                                            "not an ip", "2001:db8::"]),
              rng.choice([None, 79, 80, 81, 129, 130, 443, 999, 1000, 2999, 3000])) for _ in range(500)]
    rdf = spark.createDataFrame(rules, "organization_id int, ip_range string, ip_address string, port_lo int, port_hi int, "
                                       "direction string, is_active boolean")
    fdf = spark.createDataFrame(flows, "organization_id int, destination_ip string, dst_port int")
    for r in allowlist.check_flows(fdf, rdf).collect():
        assert r.allowed == brute_allowed((r.organization_id, r.destination_ip, r.dst_port), rules), r


def test_expired_rules_do_not_count(spark):
    rules = spark.createDataFrame(
        [(1, "10.0.0.0/8", None, None, None, "outbound", True, dt.datetime(2024, 1, 1))],
        "organization_id int, ip_range string, ip_address string, port_lo int, port_hi int, direction string, "
        "is_active boolean, expires_at timestamp")
    flows = spark.createDataFrame([(1, "10.0.0.1", 1)], "organization_id int, destination_ip string, dst_port int")
    assert allowlist.check_flows(flows, rules, now()).first().allowed is False
    assert allowlist.check_flows(flows, rules, F.to_timestamp(F.lit("2023-06-01"))).first().allowed is True


def test_product_matching_equals_substring_search(spark):
    rng = random.Random(9)
    words = ["openssh", "apache", "nginx", "mysql", "postgresql"]
    bits = ["x", " ", "ab", "server", "aa"]
    text = lambda n: "".join(rng.choice(bits + words) for _ in range(n))
    products = sorted({p for p in (text(3).strip() for _ in range(150)) if any(w in p for w in words)})
    threats = [(i, f"CVE-{i}", float(rng.randrange(10)), None if i % 17 == 0 else text(8).upper(),
                [f"cpe:2.3:a:v:{rng.choice(products)}:1"] if i % 5 == 0 else None) for i in range(200)]
    tdf = spark.createDataFrame(threats, "threat_id int, cve_id string, cvss_v3_score double, description string, "
                                         "cpe_matches array<string>")
    pdf = spark.createDataFrame([(p,) for p in products], "product_key string")
    got = {(r.product_key, r.threat_id) for r in vuln.match_products(pdf, tdf, k=1000).collect()}
    want = {(p, t[0]) for p in products for t in threats
            if (t[3] and p in t[3].lower()) or (t[4] and t[4][0].split(":")[4] == p)}
    assert got == want
    per = [r["n"] for r in vuln.match_products(pdf, tdf, k=3).groupBy("product_key").agg(F.count("*").alias("n")).collect()]
    assert max(per) <= 3


def finding(spark, rows):
    return spark.createDataFrame(rows, FINDING)


def test_asset_upsert_laws(spark):
    none = spark.createDataFrame([], ASSETS)
    a = finding(spark, [(1, "s", "10.0.0.1", "aa:aa", "h1", "Linux", "5", 90, [22], [], True, "network_scan"),
                        (1, "s", "10.0.0.2", None, None, None, None, None, [], [], False, "network_scan")])
    once = inventory.upsert_assets(none, a, now())
    twice = inventory.upsert_assets(once.drop("action"), a, now())
    assert sorted(map(str, once.drop("action").collect())) == sorted(map(str, twice.drop("action").collect()))
    assert tuple(merging.action_counts(once).first()) == (2, 0) and tuple(merging.action_counts(twice).first()) == (0, 2)
    b = finding(spark, [(1, "s", "10.0.0.1", None, None, "BSD", None, None, [], [], False, "network_scan")])
    row = inventory.upsert_assets(once.drop("action"), b, now()).filter("ip_address = '10.0.0.1'").first()
    assert (row.mac_address, row.hostname, row.os_family, row.os_version) == ("aa:aa", "h1", "BSD", "5")
    assert row.open_ports == [] and row.is_server is False and row.action == "updated"


NVD = {"vulnerabilities": [
    {"cve": {"id": "CVE-1", "published": "2024-01-01T00:00:00.000", "lastModified": "bad",
             "descriptions": [{"lang": "de", "value": "d"}, {"lang": "en", "value": "e"}],
             "metrics": {"cvssMetricV31": [{"cvssData": {"baseScore": 0.0, "vectorString": "v31"}}],
                         "cvssMetricV30": [{"cvssData": {"baseScore": 9.0}}],
                         "cvssMetricV2": [{"cvssData": {"baseScore": 5.0}}]},
             "configurations": [{"nodes": [{"cpeMatch": [{"vulnerable": i % 2 == 0, "criteria": f"c{i}"} for i in range(300)]}]},
                                {"nodes": [{}]}, {}],
             "references": [{"url": f"u{i}", "tags": ["Exploit"] if i % 2 else None} for i in range(60)]}},
    {"cve": {"id": "CVE-2", "descriptions": [{"lang": "fr", "value": "f"}],
             "metrics": {"cvssMetricV30": [{"cvssData": {"baseScore": 7.1, "vectorString": "v30"}}]}}},
    {"cve": {"id": "CVE-3"}}]}


def test_nvd_parsing_edges(spark, tmp_path):
    (tmp_path / "p1.json").write_text(json.dumps(NVD, indent=1))
    r = {x.cve_id: x for x in feeds.read_nvd(spark, str(tmp_path), 100, 20).collect()}
    every = {x.cve_id: x for x in feeds.read_nvd(spark, str(tmp_path)).collect()}["CVE-1"]
    assert (len(every.cpe_matches), len(every.exploit_references)) == (150, 30)
    one = r["CVE-1"]
    assert (one.description, one.cvss_v3_score, one.cvss_v3_vector, one.severity) == ("e", 0.0, "v31", "medium")
    assert one.last_modified_at is None and one.published_at is not None
    assert one.cpe_matches == [f"c{i}" for i in range(0, 200, 2)] and one.exploit_references == [f"u{i}" for i in range(1, 41, 2)]
    assert (r["CVE-2"].description, r["CVE-2"].severity, r["CVE-2"].cvss_v3_vector) == ("f", "high", "v30")
    assert (r["CVE-3"].description, r["CVE-3"].severity, r["CVE-3"].cpe_matches) == (None, "medium", [])


def test_feed_order_and_kept_severity(spark, tmp_path):
    (tmp_path / "n").mkdir(), (tmp_path / "k").mkdir()
    (tmp_path / "n" / "1.json").write_text(json.dumps(NVD))
    (tmp_path / "k" / "1.json").write_text(json.dumps({"vulnerabilities": [
        {"cveID": "CVE-2", "vulnerabilityName": "n", "dateAdded": "2024-01-05", "dueDate": "05/01/2024", "vendorProject": "v"},
        {"cveID": "CVE-2", "vulnerabilityName": "later", "dateAdded": "2024-01-06", "dueDate": "2024-02-06",
         "vendorProject": "v", "product": "p"}]}))
    kev = thr.apply_kev(jobs.empty_threats(spark), thr.last_in_batch(feeds.read_kev(spark, str(tmp_path / "k"))), now())
    row = kev.first()
    assert (kev.count(), row.title, row.severity, str(row.cisa_due_date), row.affected_products[0].product) == (
        1, "later", "critical", "2024-02-06", "p")
    batch = thr.last_in_batch(feeds.read_nvd(spark, str(tmp_path / "n")))
    plain = thr.apply_nvd(kev.drop("action"), batch, now()).filter("cve_id = 'CVE-2'").first()
    kept = thr.apply_nvd(kev.drop("action"), batch, now(), keep_kev_severity=True).filter("cve_id = 'CVE-2'").first()
    assert (plain.severity, plain.source, plain.is_exploited_in_wild, kept.severity) == ("high", "cisa_kev", True, "critical")


def test_scan_report_parsing(spark, tmp_path):
    report = {"organization_id": 1, "scan_id": "s", "ip_address": "10.0.0.1", "addresses": {"mac": "AA:BB"},
              "hostnames": [{"name": "h"}, {"name": "other"}], "osmatch": [{"name": "L", "accuracy": "x", "osclass": []}],
              "tcp": {"22": {"state": "open", "name": "ssh"}, "81": {"state": "closed"}}, "udp": {"9999": {"state": "open"}}}
    (tmp_path / "r.json").write_text(json.dumps(report) + "\n" + json.dumps({"organization_id": 1, "ip_address": "10.0.0.2"}))
    rows = {r.ip_address: r for r in scans.normalise(scans.read_reports(spark, str(tmp_path))).collect()}
    a, b = rows["10.0.0.1"], rows["10.0.0.2"]
    assert (a.mac_address, a.hostname, a.os_version, a.os_family, a.os_accuracy) == ("aa:bb", "h", "L", None, 0)
    assert sorted(a.open_ports) == [22, 9999] and a.is_server and [s.protocol for s in a.services] == ["tcp", "udp"]
    assert b.open_ports == [] and b.services == [] and not b.is_server


def sequential(tasks, approvals):
    """The approval rules, one event at a time."""
    state = {t: dict(status=s, risk=r, a=None, at=None, b=None, bt=None) for t, r, s in tasks}
    rejected = []
    for task, by, at, seq in sorted(approvals, key=lambda x: (x[2], x[3], x[1])):
        s = state.get(task)
        if s is None or s["status"] != "pending_approval":
            rejected.append((task, by, at, seq))
        elif s["risk"] in ("high", "critical"):
            if s["a"] is not None and s["a"] != by:
                s.update(b=by, bt=at, status="approved")
            else:
                s.update(a=by, at=at)
        else:
            s.update(a=by, at=at, status="approved")
    return state, rejected


def test_approvals_match_a_sequential_run(spark):
    rng = random.Random(8)
    tasks = [(i, rng.choice(["low", "medium", "high", "critical"]),
              rng.choice(["pending_approval", "pending_approval", "approved"])) for i in range(80)]
    approvals = [(rng.randrange(90), rng.randrange(3), dt.datetime(2024, 1, 1 + rng.randrange(4)), i) for i in range(400)]
    tdf = spark.createDataFrame(tasks, "task_id int, risk_level string, status string")
    adf = spark.createDataFrame(approvals, "task_id int, approved_by int, approved_at timestamp, seq int")
    state, rejected = sequential(tasks, approvals)
    for r in rem.apply_approvals(tdf, adf, now()).collect():
        s = state[r.task_id]
        assert (r.status, r.approved_by, r.approved_at, r.secondary_approved_by, r.secondary_approved_at) == (
            s["status"], s["a"], s["at"], s["b"], s["bt"]), r
    got = {(r.task_id, r.approved_by, r.approved_at, r.seq) for r in rem.rejected_approvals(tdf, adf).collect()}
    assert got == set(rejected)


def test_validators(spark):
    rows = spark.createDataFrame([
        ("u", "URN:x", "10.0.0.1"), ("v", "urn:uuid:123e4567-e89b-12d3-a456-426614174000", "8.8.8.8"),
        ("w", "{123E4567e89b12d3a456426614174000}", "224.0.0.1")], "id string, uuid string, ip string")
    good, bad = quality.validate(rows, {"uuid": ("uuid", {}), "ip": ("ip", {"allow_private": False})})
    assert [tuple(r) for r in good.collect()] == [("v", "123e4567-e89b-12d3-a456-426614174000", "8.8.8.8")]
    assert {r.id: r.reasons for r in bad.collect()} == {
        "u": ["uuid:invalid_uuid", "ip:private_ip"], "w": ["ip:multicast_ip"]}


ATTACKS = ["x OR 1=1 AND 2=2", "union  SELECT a", "drop\ttable t", "delete from t", "INSERT INTO t", "update t set x",
           "a -- b", "/* c */", "; drop", "XP_CMDSHELL", "<script>x</script>", "JavaScript:1", "onclick =", "<iFrame", "<object",
           "<embed", "unſet upſert", "ſelect union ſelect", "plain text", "y or 1=1", "onéx=", None]


def test_injection_scan_agrees_with_re(spark):
    import re

    df = spark.createDataFrame(list(enumerate(ATTACKS)), "id int, body string")
    got = {(r.id, r.family, r.pattern) for r in quality.injection_hits(df, "id", ["body"]).collect()}
    want = {(i, fam, p) for i, s in enumerate(ATTACKS) if s for fam in ("sql", "script") for p in quality.FAMILIES[fam]
            if re.search(p, s.upper() if fam == "sql" else s.lower(), re.I)}
    assert got == want
    strict = quality.injection_hits(df, "id", ["body"], ["sql"], strict=True)
    assert (19, quality.STRICT_FIRST) in {(r.id, r.pattern) for r in strict.collect()}


def test_injection_scan_takes_time_in_proportion(spark):
    """Equal answers on texts of awkward pieces, and long texts that made a scan quadratic."""
    import re
    import time

    rng = random.Random(6)
    bits = ["OR", "AND", " ", "\n", "=", "a", "or", "x", "/*", "*/", "/", "*", "on", "onx", "\t", "==", "band", "\n\n", "b=", "-"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    patterns = {q for q in quality.LINEAR if q != quality.STRICT_FIRST}
    got = {(r.id, r.pattern) for r in quality.injection_hits(df, "id", ["body"]).collect() if r.pattern in patterns}
    assert got == {(i, q) for i, s in enumerate(texts) for q in patterns if re.search(q, s, re.I)}
    strict = quality.injection_hits(df, "id", ["body"], ["sql"], strict=True).collect()
    assert {r.id for r in strict if r.pattern == quality.STRICT_FIRST} == {i for i, s in enumerate(texts) if re.search(quality.STRICT_FIRST, s, re.I)}

    def seconds(size, strict=False):
        long = ["this and that " * size + "=", "/*" * 7 * size, "on" * 7 * size + " =" * 0 + "- = -", "or " * 5 * size + "="]
        rows = spark.createDataFrame(list(enumerate(long)), "id int, body string").coalesce(1).cache()
        rows.count()
        start = time.time()
        quality.injection_hits(rows, "id", ["body"], strict=strict).collect()
        return time.time() - start

    seconds(10)
    assert seconds(80_000) < 20 and seconds(80_000, True) < 20  # over a megabyte each; before, minutes for a tenth of it


def test_only_suspect_json_reaches_python(spark):
    from pyspark.sql import Row

    texts = ['{"a": [1, {"b": 2}]}', '{"Pass\\u0077ord": 1, "x": "y"}', '{"x": "my TOKEN"}', '["token"]', '{"API_KEY": {"a": 1}}', "", None, "{broken token"]
    df = spark.createDataFrame([Row(t=t) for t in texts], "t string")
    rows = df.select(redaction.redact_json("t").alias("r"), redaction.may_hold_secret(F.col("t")).alias("s")).collect()
    assert [r.s for r in rows] == [False, True, True, True, True, False, False, True]
    mask = redaction.MASK
    assert [r.r for r in rows] == [texts[0], json.dumps({"Password": mask, "x": "y"}, separators=(",", ":")), '{"x":"my TOKEN"}', texts[3],
                                   json.dumps({"API_KEY": mask}, separators=(",", ":")), "", None, texts[7]]


def test_redaction_depths(spark):
    text = json.dumps({"a": {"Password": 1, "b": [{"my_token": [1]}, 3, [{"pwd": 1}]]}, "auth": {"x": 1}})
    row = spark.createDataFrame([(text,), ("no json",), (None,)], "t string").select(redaction.redact_json("t").alias("r")).collect()
    assert json.loads(row[0].r) == {"a": {"Password": redaction.MASK, "b": [{"my_token": redaction.MASK}, 3, [{"pwd": 1}]]},
                                    "auth": redaction.MASK}
    assert [r.r for r in row[1:]] == ["no json", None]


def test_text_normalise_limits(spark):
    df = spark.createDataFrame([(" a\x00b ",), ("x" * 6,), ("ﬁ",)], "t string")
    assert [(r.t, r.error) for r in quality.normalise_text(df, "t", 5).collect()] == [
        ("ab", None), (None, "text_too_long"), ("fi", None)]


def test_training_files_skip_broken_ones(spark, tmp_path):
    spark.createDataFrame([(1.0,)], "tcp_ratio double").write.parquet(str(tmp_path / "a"))
    (tmp_path / "b.parquet").write_bytes(b"no parquet at all")
    assert [r.tcp_ratio for r in datasets.read_training_files(spark, str(tmp_path)).collect()] == [1.0]
    (tmp_path / "empty").mkdir()
    try:
        datasets.read_training_files(spark, str(tmp_path / "empty"))
        raise AssertionError("expected an error")
    except ValueError:
        pass


def listed(spark, folder):
    return datasets.list_objects(spark, str(folder)).select(F.col("key").alias("path"), F.col("size").alias("length"))


def test_integrity_of_files(spark, tmp_path):
    import hashlib

    from palisade.sources import files

    (tmp_path / "in").mkdir()
    body = {"a": b"a" * 3_000_001, "b b%20": bytes(range(256)) * 40, "c": b"", "e": b"x" * 4096, "f": b"y" * 4097}
    for n, content in body.items():
        (tmp_path / "in" / n).write_bytes(content)
    # Spark's listing leaves out the empty file
    listing = listed(spark, tmp_path / "in").union(spark.createDataFrame([(f"file:{tmp_path}/in/c", 0)], "path string, length long")).cache()
    name = F.element_at(F.split("path", "/"), -1).alias("path")
    for algorithm in ("md5", "sha256", "sha512"):
        found = {r.path: r.digest for r in files.file_digests(listing, algorithm).select(name, "digest").collect()}
        assert found == {n: hashlib.new(algorithm, content).hexdigest() for n, content in body.items()}
    blocks = files.block_digests(listing, block_bytes=4096)
    want = {(n, i): hashlib.sha256(c[i * 4096:(i + 1) * 4096]).hexdigest() for n, c in body.items() for i in range(max(1, -(-len(c) // 4096)))}
    assert {(r.path, r.block): r.digest for r in blocks.select(name, "block", "digest").collect()} == want
    tree = {r.path: r.digest for r in files.tree_digests(blocks).select(name, "digest").collect()}
    top = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    assert tree == {n: top([top(want[n, i] for i in range(max(1, -(-len(c) // 4096))))]) for n, c in body.items()}
    manifest = files.file_digests(listing).filter(name != "c").select("path", "digest")
    gone = listing.agg(F.min("path")).first()[0].rsplit("/", 1)[0] + "/d"
    manifest = manifest.union(spark.createDataFrame([(gone, "x")], "path string, digest string")).cache()
    before = blocks.cache()
    assert manifest.count() == 5 and before.count() == len(want)
    (tmp_path / "in" / "f").write_bytes(b"y" * 4096 + b"z")
    (tmp_path / "in" / "e").write_bytes(b"short")  # listed with its old length, it cannot be read through
    got = {r.path.rsplit("/", 1)[1]: r.status for r in archive.integrity_report(files.file_digests(listing), manifest).collect()}
    assert got == {"c": "unexpected", "d": "missing", "f": "changed", "e": "changed"}
    now = files.block_digests(listed(spark, tmp_path / "in"), block_bytes=4096)
    diff = {(r.path.rsplit("/", 1)[1], r.block, r.status) for r in files.changed_blocks(before, now).collect()}
    assert diff == {("f", 1, "changed"), ("e", 0, "changed"), ("c", 0, "removed")}  # not in the listing
    assert files.tree_digests(files.block_digests(listing.limit(0))).count() == 0


def test_a_file_of_more_than_two_gigabytes(spark, tmp_path):
    """Sparse, so it takes no room: blocks are read by separate tasks and the end of the file is seen."""
    from palisade.sources import files

    with open(tmp_path / "big", "wb") as f:
        f.truncate((2 << 30) + 5)
        f.seek(2 << 30)
        f.write(b"end")
    found = files.block_digests(listed(spark, tmp_path), "md5", 512 << 20)
    rows = {r.block: (r.size, r.digest) for r in found.collect()}
    assert len(rows) == 5 and rows[4][0] == 5 and len({d for _, d in rows.values()}) == 2
    assert files.tree_digests(found).first().digest is not None


def test_size_and_name_rules_open_no_file(spark, tmp_path):
    (tmp_path / "a.exe").write_bytes(b"x" * 3000)
    report = archive.file_policy(listed(spark, tmp_path), [".html"], 0.002)
    assert report.first().violations == ["extension", "too_large"]
    from test_plans import plan_of

    assert "content" not in plan_of(report)


def test_activation_keeps_one_active_model(spark):
    old = spark.createDataFrame([(1, "m", "v1", True, dt.datetime(2024, 1, 1), None)],
                                "organization_id int, model_name string, model_version string, is_active boolean, "
                                "training_completed_at timestamp, deactivated_at timestamp")
    fresh = spark.createDataFrame([(1, "m", "v2", dt.datetime(2024, 1, 2)), (1, "m", "v3", dt.datetime(2024, 1, 3))],
                                  "organization_id int, model_name string, model_version string, training_completed_at timestamp")
    rows = {r.model_version: r.is_active for r in models.activate(old, fresh, now()).collect()}
    assert rows == {"v1": False, "v2": False, "v3": True}


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    from test_features import EVENTS

    def batch(name, *minutes):
        rows = [(1, "10.0.0.1", "8.8.8.8", dt.datetime(2024, 1, 1, 0, m), 10.0, 6, False, 80, 1, False) for m in minutes]
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = jobs.read_events(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
        q = jobs.run_to_table(jobs.event_slices(stream), str(tmp_path / "out"), str(tmp_path / "log"))
        q.awaitTermination()
        before = sum(late.by_batch.values())
        return late.look(q) - before

    late = jobs.LateRows()

    batch("a", 0, 1, 50)
    run()
    batch("b", 2, 55)
    assert run() == 1
    done = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.n for r in done) == [1, 1] and late.complete
    # a restart without new files adds nothing
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_schema_conformance(spark):
    df = conform(spark.createDataFrame([("CVE-1",)], "cve_id string"), THREATS)
    assert len(df.columns) == 21 and KEV_DOCUMENT and NVD_DOCUMENT


def test_repeated_keys_in_one_batch_count_once_and_the_last_wins(spark):
    """Every upsert and command takes several rows of one key; the later by the given order holds."""
    from palisade.operators import anomalies, merging, remediation

    assets = spark.createDataFrame([(1, "10.0.0.1", None, "h", None, None, True, [1], "s", "x", "active")],
                                   "organization_id long, ip_address string, mac_address string, hostname string, os_family string,"
                                   "os_version string, is_server boolean, open_ports array<int>, services string,"
                                   "discovery_method string, status string")
    stamps = ("first_seen_at", "last_seen_at", "updated_at")
    assets = assets.withColumns({c: now() for c in stamps})
    found = [(1, "10.0.0.1", "m1", None, "Linux", "1", True, [22], "a", "scan", 1), (1, "10.0.0.1", None, "h2", None, "2", False, [80], "b", "scan", 2),
             (1, "10.0.0.2", None, "n1", None, None, True, [1], "c", "scan", 2), (1, "10.0.0.2", None, None, None, None, False, [2], "d", "scan", 3)]
    findings = spark.createDataFrame(found, "organization_id long, ip_address string, mac_address string, hostname string, os_family string,"
                                     "os_version string, is_server boolean, open_ports array<int>, services string,"
                                     "discovery_method string, ended int")
    out = {r.ip_address: r for r in inventory.upsert_assets(assets, findings, now(), ["ended"]).collect()}
    assert len(out) == 2 and [out[f"10.0.0.{i}"].action for i in (1, 2)] == ["updated", "new"]
    one, two = out["10.0.0.1"], out["10.0.0.2"]
    assert (one.mac_address, one.hostname, one.os_family, one.os_version, one.open_ports, one.services) == ("m1", "h2", "Linux", "2", [80], "b")
    assert (two.hostname, two.is_server, two.open_ports) == ("n1", False, [2])

    ids = spark.createDataFrame([(1, None), (2, "old")], "id long, pointer string")
    listed = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "id long, pointer string, at int")
    assert sorted(map(tuple, merging.set_where_listed(ids, listed, "id", "pointer", ["at"]).collect())) == [(1, "b"), (2, "old")]
    assert [tuple(r) for r in merging.insert_missing(listed, ids.filter("id = 2"), ["id"], ["at"]).collect()] == [(1, "b", 2)]

    vulns = spark.createDataFrame([(1, "open"), (2, "open")], "vulnerability_id long, status string")
    commands = spark.createDataFrame([(1, "ann", "x", 1), (1, "bo", "y", 2)], "vulnerability_id long, accepted_by string, justification string, at int")
    done = {r.vulnerability_id: r.accepted_by for r in vuln.accept_risk(vulns, commands, now(), order=["at"]).collect()}
    assert done == {1: "bo", 2: None}

    rows = spark.createDataFrame([(1, False), (2, False)], "detection_id long, is_acknowledged boolean")
    acks = spark.createDataFrame([(1, "ann", "x", None, 1), (1, "bo", "y", True, 2)],
                                 "detection_id long, acknowledged_by string, notes string, is_false_positive boolean, at int")
    got = {r.detection_id: (r.acknowledged_by, r.is_false_positive) for r in anomalies.acknowledge(rows, acks, now(), ["at"]).collect()}
    assert got == {1: ("bo", True), 2: (None, None)}

    tasks = spark.createDataFrame([(1, "approved", "undo"), (2, "approved", None)], "task_id long, status string, rollback_script string")
    results = spark.createDataFrame([(1, 1, "o1", "e", 1, 5), (1, 0, "o2", None, 6, 9)],
                                    "task_id long, exit_code int, stdout string, stderr string, started_at int, completed_at int")
    got = {r.task_id: (r.status, r.execution_output) for r in remediation.apply_results(tasks, results, now()).collect()}
    assert got == {1: ("completed", "o2"), 2: ("approved", None)}
    undo = spark.createDataFrame([(1, "ann", "x", 1), (1, "bo", "y", 2)], "task_id long, rolled_back_by string, reason string, at int")
    done, _ = remediation.apply_rollbacks(tasks, undo, now(), ["at"])
    assert sorted((r.task_id, r.status, r.rolled_back_by) for r in done.collect()) == [(1, "rolled_back", "bo"), (2, "approved", None)]


def test_broken_training_files_are_listed(spark, tmp_path):
    from palisade.sources import datasets

    spark.range(5).selectExpr("cast(id as double) packets_per_second").coalesce(1).write.parquet(str(tmp_path / "good"))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_bytes(b"PAR1 this is no parquet PAR1")
    assert datasets.read_training_files(spark, str(tmp_path)).count() == 5
    assert [(r.path.rsplit("/", 1)[1], r.size) for r in datasets.silent_training_files(spark, str(tmp_path)).collect()] == [("x.parquet", 28)]


def test_large_k_goes_by_ranges(spark):
    """A hot group, a null group and small ones, with more rows wanted than Spark cuts on the map side."""
    rows = [(0 if i % 5 else i % 7, (i * 7919) % 10007, i) for i in range(9000)] + [(None, i, 9000 + i) for i in range(30)]
    df = spark.createDataFrame(rows, "g int, v int, id long")
    want = set()
    for g in {r[0] for r in rows}:
        want |= {r[2] for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))[:1500]}
    got = ranking.top_per_group(df.repartition(5), ["g"], [F.desc("v"), F.col("id")], 1500).select("id").collect()
    assert len(got) == len(want) and {r.id for r in got} == want


def test_products_meet_texts_by_their_rarest_grams(spark):
    """Banners made of one repeated piece, overlapping names, short names and long texts; contains decides."""
    rng = random.Random(4)
    keys = ["apache", "apache 2", "a" * 40, "ab" * 30, "x", "php", "", "nginx\n1", "ünïcödé 5", "no such product", "the the the"]
    keys += ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    texts = ["apache 2.4 and php", "a" * 200, "ab" * 400, None, "", "x", "nginx\n1.2", "an ünïcödé 5", "the the thethe the the"]
    texts += ["".join(rng.choice("abx ") for _ in range(rng.randrange(0, 80))) for _ in range(80)] + ["the word " * 20000 + "php"]
    want = {(k, i) for k in set(keys) if k for i, t in enumerate(texts) if t is not None and k in t}
    p = spark.createDataFrame([(k,) for k in set(keys)], "product_key string")
    d = spark.createDataFrame(list(enumerate(texts)), "text_id int, body string").filter("body is not null")
    found = vuln.contained_keys(p, d)
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    filed = {r.product_key: r.gram for r in vuln.anchors(p, d).collect()}
    assert all(g in k and len(g) == min(len(k), vuln.GRAM) for k, g in filed.items())
    assert "no such product" not in filed and "" not in filed
    assert vuln.contained_keys(p.limit(0), d).count() == 0 and vuln.contained_keys(p, d.limit(0)).count() == 0


def test_indexed_search_equals_the_plain_one(spark, tmp_path):
    """Short and unknown terms, wildcards, letter case, terms across lines, null texts; few buckets are read."""
    from test_plans import plan_of

    from palisade.operators.searching import TextIndex, containing

    rng = random.Random(9)
    words = ["Apache", "apache", "HTTP", "50%", "a_b", "Straße", "çelik", "x\ny", "remote", "code", "0001", "İstanbul"]
    rows = [(f"CVE-{i:04d}", rng.choice([None, " ".join(rng.choices(words, k=2))]), " ".join(rng.choices(words, k=rng.randrange(0, 9))))
            for i in range(400)]
    df = spark.createDataFrame(rows, "cve_id string, title string, description string").repartition(3)
    index = TextIndex(spark, str(tmp_path / "i"), buckets=8)
    index.build(df)
    for term in ("apache", "HTTP 50%", "a_b", "aXb", "STRASSE", "straße", "ÇEL", "x\ny", "ap", "", "%", "cve-0007", "nowhere", "0001 remote", "code CVE"):
        want = sorted(r.cve_id for r in containing(df, term).collect())
        found = index.search(term)
        assert found.columns == df.columns and sorted(r.cve_id for r in found.collect()) == want, term
    assert index.rarest("ap") is None and index.rarest("nowhere") == [] and len(index.rarest("cve-0007")) == 3
    plan = plan_of(index.search("cve-0007"))
    assert "dynamicpruning" in plan and plan.count("PartitionFilters") >= 2 and "PushedFilters: [IsNotNull(gram), In(gram" in plan.replace("[In(gram", "[IsNotNull(gram), In(gram")
    empty = TextIndex(spark, str(tmp_path / "e"), buckets=2)
    empty.build(df.limit(0))
    assert empty.search("apache").count() == 0


def test_texts_are_never_sent_whole_when_products_meet_them(spark, tmp_path):
    """A compressed table looks small enough to send, and as small once its texts are taken apart into grams."""
    spark.range(2000).select(F.col("id").alias("threat_id"), F.lit("CVE").alias("cve_id"), F.lit(1.0).alias("cvss_v3_score"),
                             F.lit("flaw in nginx server").alias("description"),
                             F.array(F.lit("a:b:c:d:nginx")).alias("cpe_matches")).write.parquet(str(tmp_path / "t"))
    threats = spark.read.parquet(str(tmp_path / "t"))
    services = spark.range(50).selectExpr("id AS service_id", "'nginx' AS product", "'nginx/1.10' AS version")
    found = vuln.match_products(vuln.outdated_services(services), threats, 10)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert found.count() == 10


def test_a_hot_product_is_spread_over_cells(spark):
    """All pairs of one product, and of others beside it, without one task for the product."""
    services = spark.range(600).select(
        F.col("id").alias("asset_id"), F.when(F.col("id") % 50 == 0, "mysql").otherwise("nginx").alias("product"),
        F.lit("nginx/1.10 MySQL 5.5").alias("version"), F.create_map(F.lit("a"), F.col("id")).alias("extra"))
    threats = spark.range(300).select(
        F.col("id").alias("threat_id"), F.lit("c").alias("cve_id"), F.lit(1.0).alias("cvss_v3_score"),
        F.when(F.col("id") % 3 == 0, "mysql").otherwise("an nginx flaw").alias("description"),
        F.lit(None).cast("array<string>").alias("cpe_matches"))
    found = vuln.correlate(services, threats, None)
    rows = found.select("asset_id", "threat_id").collect()
    assert len(rows) == len(set(rows)) == 588 * 200 + 12 * 100
    assert all((r.asset_id % 50 == 0) == (r.threat_id % 3 == 0) for r in rows)
    left = services.select("asset_id", F.substring("product", 99, 9).alias("key"))
    right = threats.select("threat_id", F.substring("description", 99, 9).alias("key"))
    tasks = vuln.join_in_cells(left, right, "key", 30).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in tasks) == 180000 and max(r["count"] for r in tasks) < 60000


def test_a_product_of_a_few_thousand_rows_is_spread_too(spark):
    """Millions of pairs of one product, of fewer rows a side than went to one task whole, are many short tasks."""
    rare = F.col("id") % 50 == 0
    services = spark.range(3000).select(
        F.col("id").alias("asset_id"), F.when(rare, "mysql").otherwise("nginx").alias("product"),
        F.lit("nginx/1.10 MySQL 5.5").alias("version"))
    threats = spark.range(3000).select(
        F.col("id").alias("threat_id"), F.lit("c").alias("cve_id"), F.lit(1.0).alias("cvss_v3_score"),
        F.when(rare, "mysql").otherwise("an nginx flaw").alias("description"),
        F.lit(None).cast("array<string>").alias("cpe_matches"))
    tasks = vuln.correlate(services, threats, None).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in tasks) == 2940 * 2940 + 60 * 60
    assert max(r["count"] for r in tasks) < 5_000_000


def test_all_threats_of_a_product_are_found(spark, tmp_path):
    """A product with more than ten threats keeps them all, in both queries of the correlation."""
    from palisade.plans.catalog import CATALOG

    spark.range(60).selectExpr("id AS p_partkey", "concat('part', id) AS p_name", "'STEEL' AS p_type", "1 AS p_size").write.parquet(
        str(tmp_path / "part.parquet"))
    spark.createDataFrame([(6, 3), (36, 4), (1, 5), (21, 5)], "o_orderkey long, o_custkey long").write.parquet(
        str(tmp_path / "orders.parquet"))
    want = sorted([(a, s, t) for a, s in ((3, 6), (4, 36)) for t in range(1, 60, 5)] + [(5, 1, 51), (5, 1, 56)])
    for name in ("jn6_service_correlation", "jn6_service_correlation_all"):
        found = CATALOG[name](spark, str(tmp_path)).collect()
        assert sorted((r.asset_id, r.service_id, r.threat_id) for r in found) == want, name


def test_all_criteria_and_references_of_an_advisory_are_read(spark, tmp_path):
    """An advisory with more than 100 criteria and 20 references keeps them all, in both queries."""
    from palisade.plans.catalog import CATALOG

    spark.createDataFrame([(1, 60), (2, 41), (3, 3)], "p_partkey long, p_size int").selectExpr(
        "*", "concat('part', p_partkey) AS p_name", "'STEEL' AS p_type").write.parquet(str(tmp_path / "part.parquet"))
    for name in ("src1_nvd_records", "src1_nvd_records_all"):
        found = CATALOG[name](spark, str(tmp_path)).collect()
        assert sorted((r.cve_id[-1], r.cpes, r.exploit_refs) for r in found) == [
            ("1", 150, 40), ("2", 103, 28), ("3", 8, 2)], name


def test_texts_become_files_and_a_listing_by_tasks(spark, tmp_path):
    """Null and repeated keys' texts, many batches, and folders that do not grow with the files."""
    from palisade.sources import files

    rows = [(i, None if i % 7 == 0 else "é" * (i % 5)) for i in range(3000)] + [(5, "again"), (6, "x\ny")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    root = f"file://{tmp_path}/made"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        files.write_texts(df, "doc_id", "text", root, folders=16)
        files.write_texts(df, "doc_id", "text", root, folders=16)  # as a repeated task would
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    want = {}
    for k, text in rows:
        want.setdefault(k, []).append((text or "").encode() + b"\n")
    listing = files.list_texts(spark, root, folders=16).collect()
    assert len(listing) == 3000 and len(list((tmp_path / "made").iterdir())) <= 16
    for r in listing:
        path = r.path.removeprefix("file://")
        content = open(path, "rb").read()
        parts = want[int(path.rsplit("/", 1)[1].removesuffix(".txt"))]
        assert r.length == len(content) and content in {b"".join(parts), b"".join(parts[::-1])}
    assert files.list_texts(spark, f"file://{tmp_path}/none").count() == 0


def test_feed_records_are_made_by_the_tasks_of_their_pages(spark, tables):
    """One scan task must not make the records of all pages, which are far larger than its rows."""
    from palisade.plans import feeds as plans

    made = plans.nvd_feed(tables)
    pages = {r.page for r in made.select("page").distinct().collect()}
    tasks = made.select("page", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(tasks) == len(pages) and made.rdd.getNumPartitions() >= 32
    path = plans.land_pages(tables, made, "pages")
    stored = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length").collect()
    assert len(stored) == len(pages) and all(r.path.endswith(".gz") for r in stored)


def test_an_object_of_many_parts_is_listed_once(spark, tmp_path):
    rows = spark.range(0, 1000, numPartitions=7).select(
        F.when(F.col("id") % 3 == 0, "de").otherwise("en").alias("lang"), F.lit("abc").alias("text"))
    rows.write.partitionBy("lang").text(str(tmp_path / "o"))
    got = {r.key.rsplit("/", 1)[1]: (r.size, r.parts) for r in datasets.list_part_objects(spark, str(tmp_path / "o")).collect()}
    assert got == {"lang=de": (334 * 4, 7), "lang=en": (666 * 4, 7)}
