"""Column validation, text scans and constraint reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade.functions.net import (LOOPBACK, MULTICAST, address_sql, canonical_ip, in_blocks_sql, let, parse_cidr_sql,
                                    private_sql, render_cidr_sql)
from palisade.functions.text import nfkc
from palisade.schemas import ALLOWED

# Accepted shapes.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
HOSTNAME = (r"^(?=.{1,255}$)[0-9A-Za-z](?:(?:[0-9A-Za-z]|-){0,61}[0-9A-Za-z])?"
            r"(?:\.[0-9A-Za-z](?:(?:[0-9A-Za-z]|-){0,61}[0-9A-Za-z])?)*$")
CVE_ID = r"^CVE-\d{4}-\d{4,}$"
MAX_NAME = 255

# Injection patterns by family, matched without regard to case.
SQL_PATTERNS = (
    r"(\bOR\b|\bAND\b).*?=.*?=",
    r"UNION\s+SELECT",
    r"DROP\s+TABLE",
    r"DELETE\s+FROM",
    r"INSERT\s+INTO",
    r"UPDATE\s+\w+\s+SET",
    r"--",
    r"/\*.*?\*/",
    r";\s*DROP",
    r"xp_cmdshell",
)
SCRIPT_PATTERNS = (
    r"<script[^>]*>.*?</script>",
    r"javascript:",
    r"on\w+\s*=",
    r"<iframe",
    r"<object",
    r"<embed",
)
PATH_PATTERNS = (
    r"\.\./",
    r"\.\.\\",
    r"%2e%2e",
    r"\.\.%2f",
)
# A literal every match of the pattern contains: most texts lack it, and looking for it is cheap.
SQL_LITERALS = ("=", "union", "drop", "delete", "insert", "update", "--", "/*", "drop", "xp_cmdshell")
SCRIPT_LITERALS = ("<script", "javascript:", "=", "<iframe", "<object", "<embed")
PATH_LITERALS = ("../", "..\\", "%2e", "..%2f")
LITERALS = {"sql": SQL_LITERALS, "script": SCRIPT_LITERALS, "path": PATH_LITERALS}
# One comparison is enough after OR/AND in the strict variant.
STRICT_FIRST = r"(\bOR\b|\bAND\b)\s+\S.*?="
# The same answers in time proportional to the text: what can only start a match once a line or word is anchored there,
# and the first possible start is not given up for a later one that would see less of the line.
_TOKEN = r"(?:\bOR\b|\bAND\b)"
LINEAR = {
    SQL_PATTERNS[0]: rf"(?m)^(?>.*?{_TOKEN})[^=\n]*+=[^=\n]*+=",
    SQL_PATTERNS[7]: r"(?m)^(?>.*?/\*).*?\*/",
    SCRIPT_PATTERNS[2]: r"(?<!\w)(?>\w*?on\w+)\s*+=",
    STRICT_FIRST: rf"(?m)^(?>.*?{_TOKEN}[^\S\n]++\S)[^=\n]*+=|{_TOKEN}[^\S\n]*+\n\s*+\S.*?=",
}
FAMILIES = {"sql": SQL_PATTERNS, "script": SCRIPT_PATTERNS, "path": PATH_PATTERNS}
# any case, Unicode letters, and "." stops at a line feed only
FLAGS = "(?iudU)"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


# --- validators: each gives (normalised value, reason or null) ------------------------------

def check_ip(column: str, allow_private: bool = True) -> tuple[Column, Column]:
    private = "" if allow_private else f"when {private_sql('s')} then 'private_ip'"
    verdict = f"""case when s is null then 'invalid_ip' {private} when {in_blocks_sql('s', LOOPBACK)} then 'loopback_ip'
        when {in_blocks_sql('s', MULTICAST)} then 'multicast_ip' end"""
    return canonical_ip(column), F.expr(let("s", address_sql(column), verdict))


def check_cidr(column: str, max_hosts: int | None = None) -> tuple[Column, Column]:
    limit = "" if not max_hosts else (
        f"when pow(2.0D, if(net.family = 4, 32, 128) - net.prefix) > {int(max_hosts)} then 'range_too_large'")
    verdict = f"case when net is null then 'invalid_cidr' {limit} end"
    net = parse_cidr_sql(column)
    return F.expr(let("net", net, render_cidr_sql("net"))), F.expr(let("net", net, verdict))


def check_port(column: str) -> tuple[Column, Column]:
    digits = stripped(F.col(column).cast("string"))
    value = F.when(digits.rlike(r"^[+-]?\d+$"), digits.try_cast("decimal(38,0)"))
    reason = F.when(value.isNull(), "invalid_port").when(~value.between(1, 65535), "port_out_of_range")
    return value.try_cast("int"), reason


def check_email(column: str) -> tuple[Column, Column]:
    value = F.lower(stripped(F.col(column)))
    return value, (F.when(~F.coalesce(value.rlike(EMAIL), F.lit(False)), "invalid_email")
                   .when(F.length(value) > MAX_NAME, "email_too_long"))


def check_hostname(column: str) -> tuple[Column, Column]:
    value = F.lower(stripped(F.col(column)))
    return value, F.when(~F.coalesce(value.rlike(HOSTNAME), F.lit(False)), "invalid_hostname")


def check_uuid(column: str) -> tuple[Column, Column]:
    bare = F.lower(F.regexp_replace(F.regexp_replace(F.col(column), "urn:|uuid:", ""), r"^[{}]+|[{}]+$|-", ""))
    value = F.regexp_replace(bare, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return value, F.when(~F.coalesce(bare.rlike("^[0-9a-f]{32}$"), F.lit(False)), "invalid_uuid")


def check_cve(column: str) -> tuple[Column, Column]:
    value = F.upper(stripped(F.col(column)))
    return value, F.when(~F.coalesce(value.rlike(CVE_ID), F.lit(False)), "invalid_cve")


CHECKS = {"ip": check_ip, "cidr": check_cidr, "port": check_port, "email": check_email, "hostname": check_hostname,
          "uuid": check_uuid, "cve": check_cve}


def validate(df: DataFrame, rules: dict[str, tuple[str, dict]]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass with normalised columns, and rejects with their original values and reasons.

    ``rules`` maps a column to (kind, options).
    """
    checked = {c: CHECKS[kind](c, **options) for c, (kind, options) in rules.items()}
    rows = df.select(
        "*", F.array_compact(F.array(*[
            F.when(reason.isNotNull(), F.concat(F.lit(f"{c}:"), reason)) for c, (_, reason) in checked.items()
        ])).alias("reasons"))
    good = rows.filter(F.size("reasons") == 0).select(
        *[checked[c][0].alias(c) if c in checked else F.col(c) for c in df.columns])
    return good, rows.filter(F.size("reasons") > 0)


# --- text -----------------------------------------------------------------------------------

def injection_hits(df: DataFrame, key: str, columns: list[str], families=("sql", "script"),
                   strict: bool = False) -> DataFrame:
    """One row per (key, column, pattern) found; every text is read whole, in time proportional to its length.

    Only many script openings in one line without an end can take longer.
    """
    patterns = [(f, literal, STRICT_FIRST if strict and f == "sql" and i == 0 else p)
                for f in families for i, (p, literal) in enumerate(zip(FAMILIES[f], LITERALS[f]))]
    # folding up and then down also brings the odd letters (long s, Kelvin sign) to their plain form
    folded = df.select(key, *columns, *[F.lower(F.upper(c)).alias(f"__{c}") for c in columns])
    found = [F.when(F.col(f"__{c}").contains(literal) & F.col(c).rlike(FLAGS + LINEAR.get(p, p)), F.struct(
        F.lit(c).alias("column"), F.lit(f).alias("family"), F.lit(p).alias("pattern")))
        for c in columns for f, literal, p in patterns]
    return (folded.select(key, F.array_compact(F.array(*found)).alias("hits"))
            .select(key, F.explode("hits").alias("h")).select(key, "h.*"))


def injection_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("column", "family", "pattern").agg(F.count("*").alias("rows"))


def normalise_text(df: DataFrame, column: str, max_length: int | None = None) -> DataFrame:
    """Trim, refuse overlong text, drop NULs, then Unicode compatibility form."""
    # a column of its own, so that Spark trims once
    df, trimmed = df.withColumn("__trimmed", stripped(F.col(column))), F.col("__trimmed")
    too_long = F.length(trimmed) > max_length if max_length else F.lit(False)
    return (df.withColumn("error", F.when(too_long, "text_too_long"))
            .withColumn(column, F.when(~F.coalesce(too_long, F.lit(False)),
                                       nfkc(F.replace(trimmed, F.lit("\x00"), F.lit("")))))
            .drop("__trimmed"))


def json_fields(df: DataFrame, column: str, required: list[str], optional: list[str] | None = None) -> DataFrame:
    """Adds missing and unexpected field lists and whether the text is an object that fits."""
    def names(values) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    keys = F.json_object_keys(column)
    missing = F.array_except(names(required), keys)
    unexpected = F.array_except(keys, names(list(required) + list(optional or [])))
    return (df.withColumn("missing_fields", missing).withColumn("unexpected_fields", unexpected)
            .withColumn("is_valid", F.coalesce((F.size(missing) == 0) & (F.size(unexpected) == 0), F.lit(False))))


# --- constraints ----------------------------------------------------------------------------

def _in(column: str, words: str):
    return F.col(column).isin(*ALLOWED[words])


# Rule name -> (columns it needs, what every row must satisfy); a null outcome passes, as in SQL CHECK.
ROW_RULES = {
    "organizations": {"license_after_creation": (
        ["license_expires_at", "created_at"], lambda: F.col("license_expires_at") > F.col("created_at"))},
    "users": {"role_allowed": (["role"], lambda: _in("role", "role"))},
    "assets": {"status_allowed": (["status"], lambda: _in("status", "asset_status"))},
    "known_threats": {
        "severity_allowed": (["severity"], lambda: _in("severity", "severity")),
        "source_allowed": (["source"], lambda: _in("source", "threat_source"))},
    "asset_vulnerabilities": {
        "status_allowed": (["status"], lambda: _in("status", "vulnerability_status")),
        "confidence_range": (["detection_confidence"], lambda: F.col("detection_confidence").between(0, 1))},
    "anomaly_detections": {
        "type_allowed": (["anomaly_type"], lambda: _in("anomaly_type", "anomaly_type")),
        "severity_allowed": (["severity"], lambda: _in("severity", "severity")),
        "confidence_range": (["confidence_score"], lambda: F.col("confidence_score").between(0, 1))},
    "remediation_tasks": {
        "status_allowed": (["status"], lambda: _in("status", "remediation_status")),
        "has_source": (["vulnerability_id", "anomaly_id"],
                       lambda: F.col("vulnerability_id").isNotNull() | F.col("anomaly_id").isNotNull())},
    "network_allowlists": {
        "has_target": (["ip_range", "ip_address", "domain_pattern"],
                       lambda: F.coalesce("ip_range", "ip_address", "domain_pattern").isNotNull()),
        "direction_allowed": (["direction"], lambda: _in("direction", "direction"))},
}
UNIQUE_RULES = {
    "organizations": {"license_key_unique": (["license_key"], None)},
    "users": {"email_unique": (["organization_id", "email"], None)},
    "assets": {"address_unique": (["organization_id", "ip_address"], None)},
    "known_threats": {"cve_unique": (["cve_id"], None)},
    "asset_vulnerabilities": {"pair_unique": (["asset_id", "threat_id"], None)},
    "ml_models": {"one_active_model": (["organization_id", "model_name"], "is_active")},
}


def constraint_report(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rule, violations): broken rows per row rule, surplus keys per unique rule.

    A rule is reported when its columns are there.
    """
    parts = []
    for table, df in tables.items():
        rules = {}
        for name, (needs, condition) in ROW_RULES.get(table, {}).items():
            if set(needs) <= set(df.columns):
                rules[name] = F.count_if(~condition())
        if rules:
            counts = df.agg(F.array(*[F.struct(F.lit(n).alias("rule"), v.alias("violations"))
                                      for n, v in rules.items()]).alias("r"))
            parts.append(counts.select(F.lit(table).alias("table_name"), F.inline("r")))
        for name, (keys, condition) in UNIQUE_RULES.get(table, {}).items():
            if not set(keys + ([condition] if condition else [])) <= set(df.columns):
                continue
            rows = df.filter(condition) if condition else df
            twice = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
            parts.append(twice.agg(F.count("*").alias("violations")).select(
                F.lit(table).alias("table_name"), F.lit(name).alias("rule"), "violations"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def slow_operations(events: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Operations above the threshold in seconds, summarised; ``events``: (operation, seconds)."""
    return (events.filter(F.col("seconds") > threshold).groupBy("operation")
            .agg(F.count("*").alias("slow"), F.max("seconds").alias("worst"), F.avg("seconds").alias("mean")))
