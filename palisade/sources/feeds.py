"""Vulnerability feeds landed as JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palisade.functions.parsing import parse_date, parse_timestamp
from palisade.functions.severity import severity_from_scores
from palisade.schemas import KEV_DOCUMENT, NVD_DOCUMENT

# Reference tags and record sources.
REFERENCE_TAGS = ("Exploit", "Third Party Advisory")
NVD_DETAIL = "https://nvd.nist.gov/vuln/detail/"
KEV_CATALOGUE = "https://www.cisa.gov/known-exploited-vulnerabilities-catalog"


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per file, with its name: a feed page is a single JSON document."""
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("page", F.input_file_name())


def _records(documents: DataFrame) -> DataFrame:
    """One row per record, with its page and place in it to break ties."""
    page = F.col("page") if "page" in documents.columns else F.lit("")
    return documents.select(page.alias("page"), F.posexplode("vulnerabilities").alias("place", "v")).select(
        F.struct("page", "place").alias("ordinal"), "v")


def _first_score(metrics: Column, names, field: str) -> Column:
    """``field`` of the first metric family that is present at all."""
    pick = None
    for name in names:
        value = F.try_element_at(metrics[name], F.lit(1))["cvssData"][field]
        pick = F.when(metrics[name].isNotNull(), value) if pick is None else pick.when(
            metrics[name].isNotNull(), value)
    return pick


def _first(values: Column, limit: int | None) -> Column:
    return values if limit is None else F.slice(values, 1, limit)


def parse_nvd(documents: DataFrame, max_cpes: int | None = None, max_references: int | None = None) -> DataFrame:
    """Records of the advisory feed, with all their product criteria and references unless a limit is given."""
    cve, metrics = F.col("v.cve"), F.col("v.cve.metrics")
    texts = cve["descriptions"]
    english = F.try_element_at(F.filter(texts, lambda d: d["lang"] == "en"), F.lit(1))["value"]
    first = F.try_element_at(texts, F.lit(1))["value"]
    none = F.array().cast("array<string>")
    matches = F.flatten(F.transform(
        F.flatten(F.transform(cve["configurations"], lambda c: F.coalesce(
            c["nodes"], F.array().cast("array<struct<cpeMatch:array<struct<vulnerable:boolean,criteria:string>>>>")))),
        lambda n: F.coalesce(n["cpeMatch"], F.array().cast("array<struct<vulnerable:boolean,criteria:string>>"))))
    cpes = F.transform(F.filter(matches, lambda m: m["vulnerable"]), lambda m: F.coalesce(m["criteria"], F.lit("")))
    tags = F.array(*[F.lit(t) for t in REFERENCE_TAGS])
    urls = F.transform(
        F.filter(cve["references"], lambda r: F.coalesce(F.arrays_overlap(r["tags"], tags), F.lit(False))),
        lambda r: r["url"])
    v3 = ("cvssMetricV31", "cvssMetricV30")
    rows = _records(documents).select(
        "ordinal",
        F.coalesce(cve["id"], F.lit("")).alias("cve_id"),
        F.coalesce(cve["id"], F.lit("")).alias("title"),
        F.coalesce(english, first).alias("description"),
        _first_score(metrics, v3, "baseScore").alias("cvss_v3_score"),
        _first_score(metrics, v3, "vectorString").alias("cvss_v3_vector"),
        _first_score(metrics, ("cvssMetricV2",), "baseScore").alias("cvss_v2_score"),
        _first(F.coalesce(cpes, none), max_cpes).alias("cpe_matches"),
        _first(F.coalesce(urls, none), max_references).alias("exploit_references"),
        F.lit(False).alias("is_exploited_in_wild"),
        F.lit("nist_nvd").alias("source"),
        F.concat(F.lit(NVD_DETAIL), F.coalesce(cve["id"], F.lit(""))).alias("source_url"),
        parse_timestamp(cve["published"]).alias("published_at"),
        parse_timestamp(cve["lastModified"]).alias("last_modified_at"),
        F.to_json("v").alias("raw_data"))
    return rows.withColumn("severity", severity_from_scores(F.col("cvss_v3_score"), F.col("cvss_v2_score")))


def parse_kev(documents: DataFrame) -> DataFrame:
    v = F.col("v")
    named = (F.length(v["vendorProject"]) > 0) & (F.length(v["product"]) > 0)
    product = F.array(F.struct(v["vendorProject"].alias("vendor"), v["product"].alias("product")))
    return _records(documents).select(
        "ordinal",
        F.coalesce(v["cveID"], F.lit("")).alias("cve_id"),
        F.coalesce(v["vulnerabilityName"], F.lit("")).alias("title"),
        v["shortDescription"].alias("description"),
        F.lit(True).alias("is_exploited_in_wild"),
        F.lit("critical").alias("severity"),
        F.lit("cisa_kev").alias("source"),
        F.lit(KEV_CATALOGUE).alias("source_url"),
        parse_date(v["dateAdded"]).alias("cisa_kev_added_at"),
        parse_date(v["dueDate"]).alias("cisa_due_date"),
        v["requiredAction"].alias("cisa_required_action"),
        F.when(named, product).alias("affected_products"),
        F.lit(None).cast("timestamp").alias("last_modified_at"),
        F.to_json("v").alias("raw_data"))


def read_nvd(spark: SparkSession, path: str, max_cpes: int | None = None, max_references: int | None = None) -> DataFrame:
    return parse_nvd(read_documents(spark, path, NVD_DOCUMENT), max_cpes, max_references)


def read_kev(spark: SparkSession, path: str) -> DataFrame:
    return parse_kev(read_documents(spark, path, KEV_DOCUMENT))


def modified_between(records: DataFrame, start: Column, end: Column) -> DataFrame:
    """The incremental slice of a feed; both ends belong to it."""
    return records.filter(F.col("last_modified_at").between(start, end))
