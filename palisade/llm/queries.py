"""The registered query of each operator: whole tables in, the agreed columns out."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, fingerprints, hmm, language, licenses, line_dedup, mixing, near_dedup, pages, resampling,
               runs, secrets, sharding)
from .common import LOWER, UPPER, table

N_SHARDS = 16


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.with_copies(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    rows = sharding.assign_shards(rows, N_SHARDS)
    rows = sharding.assign_shards(rows, N_SHARDS + 1, column="grown_shard")
    return sharding.with_slots(rows, "shard", ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_scan_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.digest_columns(near_dedup.near_duplicates(docs, width=4))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                        table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.col("items").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.predict(docs, language.fit(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.scan(docs, secrets.fit(docs))


def op10_extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return pages.extract(rows, pages.fit(rows))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.ranked(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def periodic_edit(doc_id: int | None, words: list) -> list:
    """A tenth of the documents, by the CRC-32 of their id, repeats a stretch of its words up to its end."""
    h = 0 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    unit = words[a:a + 1 + (n - a) // (3 + g % 8)]
    return words[:a] + (unit * ((n - a) // len(unit) + 1))[:n - a]


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return runs.digest_columns(runs.scan_runs(docs, edit=periodic_edit))


OP1_SQL = r"""
WITH s AS (SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
p AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM s GROUP BY source),
r AS (SELECT *, CAST((rank - 1) % 3 + 1 AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS room FROM p),
h AS (SELECT *, room / weight AS height FROM r),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
                 - coalesce(sum(room) OVER (ORDER BY height, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY height, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM h),
o AS (SELECT arg_min(level, height) AS level FROM l WHERE height > level),
t AS (SELECT source, source_size, CASE WHEN height <= l.level THEN room ELSE weight * o.level END AS target
      FROM l LEFT JOIN o ON TRUE),
u AS (SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
             CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'text:' || coalesce(md5(text), ''))), 1, 13)
                  AS BIGINT) / 4503599627370496.0::DOUBLE AS draw
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM u"""

# CRC-32 by its byte table; scores as in sharding.rendezvous
OP2_SQL = f"""
WITH crc AS (SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)
                         ORDER BY n) AS steps FROM (SELECT unnest(range(256)) AS n)),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
             list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes,
             list_transform(range({N_SHARDS + 1}), lambda s: -1.0::DOUBLE / ln(CAST('0x' || substr(md5('shard:' || coalesce(CAST(doc_id AS VARCHAR), 'null')
                 || ':' || s), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE + 1 / 9007199254740992.0::DOUBLE)) AS scores FROM documents),
r AS (SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes),
                 lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8))) AS text_crc32,
             list_position(scores[:{N_SHARDS}], list_max(scores[:{N_SHARDS}])) - 1 AS shard,
             list_position(scores, list_max(scores)) - 1 AS grown_shard FROM d, crc)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INT) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, CAST(grown_shard AS INT) AS grown_shard
FROM r"""

OP4_SQL = rf"""
WITH l AS (SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                             '{UPPER}', '{LOWER}') AS k
           FROM (SELECT doc_id, s[i] AS line, i
                 FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i
                       FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)))),
r AS (SELECT k, min(doc_id) AS first_doc FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT l.*, r.k IS NOT NULL AND doc_id <> first_doc AS dropped FROM l LEFT JOIN r ON l.k = r.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mix_sources, op2_shard, op3_scan_licenses, op4_dedup_lines, op5_near_dedup,
                                op6_fingerprint, op7_decontaminate, op8_language, op9_scan_secrets, op10_extract_pages, op11_resample, op12_language_model,
                                op13_runs)}

ORACLES: dict[str, str] = {
    "op1_mix_sources": OP1_SQL,
    "op2_shard": OP2_SQL,
    "op3_scan_licenses": licenses.oracle_sql(),
    "op4_dedup_lines": OP4_SQL,
    "op5_near_dedup": near_dedup.oracle_sql(),
    "op7_decontaminate": decontaminate.ORACLE_SQL,
    "op11_resample": resampling.ORACLE_SQL,
}
