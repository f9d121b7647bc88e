import ipaddress
import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from palisade.functions import net, parsing, severity, software, text

ADDRESSES = [
    "1.2.3.4", "01.2.3.4", "256.1.1.1", "::1", "::", "fe80::1", "2001:DB8:0:0:1:0:0:1", "1:2:3:4:5:6:7:8",
    "1::2::3", "abc", "", "2001:db8::", "1:0:0:0:0:0:0:0", "192.0.0.9", "203.0.113.7", "ff02::1", "224.0.0.1",
    "127.9.9.9", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7", ":1:2:3:4:5:6:7:8", "1.2.3", "2001:4:112::5", "12345::",
    "1:0:0:2:0:0:0:3", "10.0.0.1", "172.31.255.255", "172.32.0.0", "64:ff9b::1", "1.2.3.4 ", "::1.2.3.4",
]


def test_addresses_match_the_standard_library(spark):
    rows = spark.createDataFrame([(a,) for a in ADDRESSES], "ip string").select(
        "ip", net.ip_key("ip").alias("key"), net.canonical_ip("ip").alias("text"), net.is_private("ip").alias("private"),
        net.is_loopback("ip").alias("loop"), net.is_multicast("ip").alias("multi")).collect()
    for r in rows:
        try:
            a = ipaddress.ip_address(r.ip)
        except ValueError:
            assert r.key is None and r.text is None, r
            continue
        assert (r.key, r.private, r.loop, r.multi) == (f"{int(a):032x}", a.is_private, a.is_loopback, a.is_multicast), r
        assert r.text == str(a), r


def test_mapped_address_has_the_right_key(spark):
    row = spark.range(1).select(net.ip_key("'::ffff:1.2.3.4'").alias("k")).first()
    assert row.k == f"{int(ipaddress.ip_address('::ffff:1.2.3.4')):032x}"


@pytest.mark.parametrize("cidr", [
    "10.1.2.3/24", "10.0.0.0/8", "2001:db8::1/33", "1.2.3.4", "1.2.3.4/33", "::/0", "10.0.0.0/255.255.0.0",
    "1.2.3.4/5/6", "172.16.5.4/13", "1.2.3.4/255.0.255.0", "1.1.1.1/", "1.1.1.1/32", "2001:db8::ff/126", "0.0.0.0/0"])
def test_cidr_matches_the_standard_library(spark, cidr):
    row = spark.createDataFrame([(cidr,)], "c string").select(net.parse_cidr("c").alias("n")).select(
        "n", F.expr(net.render_cidr_sql("n")).alias("text")).first()
    try:
        want = ipaddress.ip_network(cidr, strict=False)
    except ValueError:
        assert row.n is None
        return
    assert (row.n.family, row.n.prefix, row.n.network) == (want.version, want.prefixlen, f"{int(want[0]):032x}")
    assert row.text == str(want)


def test_severity_boundaries(spark):
    cases = [(0.0, None, "medium"), (0.0, 0.0, "informational"), (0.0, 5.0, "medium"), (3.9, None, "low"),
             (4.0, None, "medium"), (6.9, None, "medium"), (7.0, None, "high"), (8.9, None, "high"),
             (9.0, None, "critical"), (None, None, "medium"), (None, 9.9, "critical"), (0.1, 10.0, "low")]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, v3 double, v2 double, want string")
    got = rows.select("want", severity.severity_from_scores(F.col("v3"), F.col("v2")).alias("got")).collect()
    assert all(r.want == r.got for r in got), got


def test_confidence_boundaries(spark):
    cases = [(0.9, "general", "critical"), (0.75, "general", "high"), (0.5, "general", "medium"),
             (0.3, "general", "low"), (0.29, "general", "informational"), (0.75, "dos_loop", "high"),
             (0.76, "dos_loop", "critical"), (0.7, "backdoor_connection", "critical"), (0.9, "dos_loop", "critical")]
    rows = spark.createDataFrame(cases, "c double, k string, want string")
    got = rows.select("want", severity.severity_from_confidence(F.col("c"), F.col("k")).alias("got")).collect()
    assert all(r.want == r.got for r in got), got


def test_outdated_software(spark):
    cases = [("OpenSSH", "7.4", True, True), ("OpenSSH", "8.1", False, False), ("openssh", "6.6.1p1", True, True),
             ("nginx", "1.25.3", True, False), ("nginx", "nginx/1.18", True, False), ("Apache httpd", "2.2.3", False, True),
             ("Apache", "Apache/2.4.1", True, True), ("MySQL", "8.0.1", True, False), ("MySQL", "5.5", True, True),
             ("PostgreSQL DB", "14.2", True, False), ("redis", "1.0", False, False), ("OpenSSH", "", False, False),
             ("OpenSSH", None, False, False)]
    rows = spark.createDataFrame(cases, "p string, v string, legacy boolean, numeric boolean")
    legacy = rows.select("p", "v", "legacy", software.is_outdated(F.col("p"), F.col("v")).alias("got")).collect()
    import re
    for r in legacy:
        line = f"{r.p.lower()} {r.v}"
        want = bool(r.v) and any(w in r.p.lower() and re.search(p, line, re.I) for w, p in software.OUTDATED_PATTERNS.items())
        assert r.got == bool(want), r
    numeric = rows.select("p", "v", "numeric", software.is_outdated(F.col("p"), F.col("v"), "numeric").alias("got"))
    assert all(r.got == r.numeric for r in numeric.collect()), numeric.collect()


def test_templates(spark):
    rows = spark.createDataFrame([
        ("a {x} b {y}", {"x": "{y}", "y": "2"}), ("a {x} {z}", {"x": "1"}), ("k {q}", {}), ("no", {"x": "1"}),
        ("n {x}", None)], "t string, p map<string,string>")
    got = [tuple(r.r) for r in rows.select(text.render_template(F.col("t"), F.col("p")).alias("r")).collect()]
    assert got == [("a {y} b 2", []), (None, ["z"]), ("k {q}", []), ("no", []), ("n {x}", [])]


def test_tolerant_parsing(spark):
    rows = spark.createDataFrame([("2024-01-02T03:04:05.678Z",), ("2024-01-02",), ("x",), ("2024-13-01",), (None,),
                                  ("2024-01-02T03:04:05+02:00",)], "s string")
    got = [str(r.t)[:19] if r.t else None for r in rows.select(
        parsing.parse_timestamp(F.col("s")).cast("timestamp_ntz").alias("t")).collect()]
    assert got == ["2024-01-02 03:04:05", "2024-01-02 00:00:00", None, None, None, "2024-01-02 01:04:05"]
    days = [str(r.d) for r in rows.select(parsing.parse_date(F.col("s")).alias("d")).collect()]
    assert days == ["None", "2024-01-02", "None", "None", "None", "None"]


def test_nfkc_and_wildcards(spark):
    odd = "ﬁ①Å"
    row = spark.createDataFrame([(odd,)], "s string").select(text.nfkc("s").alias("n")).first()
    assert row.n == unicodedata.normalize("NFKC", odd)
    assert text.like_pattern("50%_\\") == "%50\\%\\_\\\\%"


def test_score_inversion(spark):
    rows = spark.createDataFrame([(-0.7,), (-0.1,), (0.0,), (0.9,)], "d double").select(
        text.invert_score(F.col("d")).alias("s")).collect()
    assert [round(r.s, 6) for r in rows] == [1.0, 0.6, 0.5, 0.0] and not any(math.isnan(r.s) for r in rows)


def test_nfkc_of_every_character_goes_to_python_only_if_it_is_not_ascii(spark):
    import unicodedata

    points = [c for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    texts = ["".join(map(chr, points[i:i + 50])) for i in range(0, len(points), 50)] + ["", "plain", None, "é"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    for r in df.select("s", text.nfkc("s").alias("n")).collect():
        assert r.n == (None if r.s is None else unicodedata.normalize("NFKC", r.s))
    # a text that is plain reaches Python as a null
    plan = df.select(text.nfkc("s").alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "octet_length" in plan
