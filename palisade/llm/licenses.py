"""License scans by diagonal voting, in DataFrame expressions only.

All rolling word pairs of a document meet the word pairs of the license templates in an equality join on their
hash. A pair at word ``p`` that a template has at ``t`` votes for the diagonal ``p - t``: the place where the
template would begin. Votes are counted by diagonal; diagonals that lie at most ``MERGE`` words apart are merged,
as words were put in or left out there; a merged span is verified by the share of the template's pairs it holds.

The base phrases are templates too: a place is a diagonal that holds every pair of the phrase.

Defined cases: a null text has no words; rows that repeat a doc_id are scanned each for itself; an empty table
gives no rows. A document is one row however long: only pairs that a template has leave the scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import RAW_WORD, UPPER, LOWER, ascii_lower

# Phrases and labels of the base rule.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# The words of short license notices.
NOTICES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided "
           "that the following conditions are met",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is "
           "hereby granted",
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                  "associated documentation files",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
MERGE = 3
SHARE = 0.8


def pair_hash(word: Column, following: Column) -> Column:
    return F.xxhash64(word, following)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def template_pairs(spark: SparkSession, base: Mapping[str, str], notices: Mapping[str, str]) -> DataFrame:
    """template, label, is_base, n_pairs, t, first, second: a local relation as large as the templates' texts."""
    rows = []
    texts = [(label, text, True) for text, label in base.items()] + [(k, v, False) for k, v in notices.items()]
    for number, (label, text, is_base) in enumerate(texts):
        words = text.split()
        if len(words) < 2:
            raise ValueError(f"template of fewer than two words: {text!r}")
        rows += [f"({number}, {_quoted(label)}, {str(is_base).lower()}, {len(words) - 1}, {t}, {_quoted(a)}, {_quoted(b)})"
                 for t, (a, b) in enumerate(zip(words, words[1:]))]
    # the row of each document's end: the empty word, which no text holds
    rows.append("(-1, '', false, 0, 0, '', CAST(NULL AS STRING))")
    return (spark.sql("SELECT * FROM VALUES " + ", ".join(rows) + " AS t(template, label, is_base, n_pairs, t, first, second)")
            .withColumn("hash", pair_hash(F.col("first"), F.col("second"))))


def votes(docs: DataFrame, base: Mapping[str, str] = BASE, notices: Mapping[str, str] = NOTICES) -> DataFrame:
    """row, doc_id, p, template, label, is_base, n_pairs, t: one row per pair that a template has.

    Each document also has one row with template -1, whose p is its number of words.
    Words are compared twice: folded, for the hash, and then exactly (A-Z lower-cased only).
    """
    words = F.array_append(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RAW_WORD), F.lit(0)), F.lit(""))
    pairs = (docs.select("doc_id", words.alias("words"))
             .withColumn("row", F.monotonically_increasing_id())
             .select("row", "doc_id", "words", F.posexplode("words").alias("p", "word"))
             .withColumn("next", F.get("words", F.col("p") + 1)).drop("words")
             .withColumn("hash", pair_hash(F.lower("word"), F.lower("next"))))
    return (pairs.join(template_pairs(docs.sparkSession, base, notices), "hash")
            .where((ascii_lower(F.col("word")) == F.col("first"))
                   & ascii_lower(F.col("next")).eqNullSafe(F.col("second")))
            .select("row", "doc_id", "p", "template", "label", "is_base", "n_pairs", "t"))


def license_spans(docs: DataFrame, base: Mapping[str, str] = BASE, notices: Mapping[str, str] = NOTICES,
                  merge: int = MERGE) -> DataFrame:
    """row, doc_id, template, label, is_base, share, first_word, last_word: merged spans of every template.

    One shuffle, by row; all further groups are parts of a document. The row of each document's end
    stays in the result, with template -1 and its number of words as last_word.
    """
    found = votes(docs, base, notices).repartition("row")
    whole = ["row", "doc_id", "template", "label", "is_base", "n_pairs"]
    diagonals = found.withColumn("diagonal", F.col("p") - F.col("t")).groupBy(*whole, "diagonal").agg(
        F.collect_set("t").alias("held"), F.min("p").alias("low"), F.max("p").alias("high"))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along), F.lit(merge + 1))
    # a base phrase is one unbroken diagonal, so each of its diagonals is a span of its own
    start = (apart > F.when(F.col("is_base"), 0).otherwise(merge)).cast("int")
    spans = (diagonals.withColumn("start", start).withColumn("span", F.sum("start").over(along))
             .groupBy(*whole, "span").agg(
                 F.size(F.array_distinct(F.flatten(F.collect_list("held")))).alias("n_held"),
                 F.min("low").alias("first_word"), F.max("high").alias("last_word")))
    share = F.when(F.col("n_pairs") > 0, F.col("n_held") / F.col("n_pairs")).otherwise(F.lit(0.0))
    return spans.select("row", "doc_id", "template", "label", "is_base", share.alias("share"), "first_word",
                        F.when(F.col("template") < 0, F.col("last_word")).otherwise(F.col("last_word") + 1)
                        .alias("last_word"))


def _joined(labels: Column) -> Column:
    return F.array_join(F.sort_array(F.collect_set(labels)), ",")


def scan_licenses(docs: DataFrame, base: Mapping[str, str] = BASE, notices: Mapping[str, str] = NOTICES,
                  merge: int = MERGE, share: float = SHARE) -> DataFrame:
    """One row per document: words, base places and labels, all labels, and the best share of a template."""
    spans = license_spans(docs, base, notices, merge)
    is_end = F.col("template") < 0
    place = F.col("is_base") & (F.col("share") == 1.0)
    label = F.when(place | (~F.col("is_base") & ~is_end & (F.col("share") >= share)), F.col("label"))
    return spans.groupBy("row", "doc_id").agg(
        F.max(F.when(is_end, F.col("last_word"))).cast("long").alias("n_words"),
        F.count(F.when(place, 1)).alias("n_base"),
        F.min(F.when(place, F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(place, F.col("first_word"))).cast("long").alias("last_word"),
        _joined(F.when(place, F.col("label"))).alias("base_labels"),
        _joined(label).alias("labels"),
        F.max("share").cast("double").alias("score")).drop("row")


def oracle_sql(base: Mapping[str, str] = BASE, notices: Mapping[str, str] = NOTICES,
               merge: int = MERGE, share: float = SHARE) -> str:
    texts = [(label, text, True) for text, label in base.items()] + [(k, v, False) for k, v in notices.items()]
    rows = ", ".join(f"({n}, '{label}', {is_base}, '{text}')" for n, (label, text, is_base) in enumerate(texts))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT * FROM (VALUES {rows}) AS v(template, label, is_base, text)),
tw AS (SELECT *, string_split(text, ' ') AS w FROM t),
tp AS (SELECT template, label, is_base, len(w) - 1 AS n_pairs, i - 1 AS t, w[i] AS a, w[i + 1] AS b
       FROM (SELECT *, unnest(range(1, len(w))) AS i FROM tw)),
dp AS (SELECT rid, i - 1 AS p, w[i] AS a, w[i + 1] AS b FROM (SELECT rid, w, unnest(range(1, len(w))) AS i FROM d)),
v AS (SELECT rid, template, label, is_base, n_pairs, p, t, p - t AS diagonal FROM dp JOIN tp USING (a, b)),
s AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) <=
                        CASE WHEN is_base THEN 0 ELSE {merge} END THEN 0 ELSE 1 END AS fresh FROM v),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, template ORDER BY diagonal) AS span FROM s),
sp AS (SELECT rid, template, label, is_base, span, count(DISTINCT t) / n_pairs AS share, min(p) AS first_word
       FROM g GROUP BY rid, template, label, is_base, n_pairs, span),
a AS (SELECT rid, count(*) FILTER (is_base AND share = 1) AS n_base,
             min(first_word) FILTER (is_base AND share = 1) AS first_word,
             max(first_word) FILTER (is_base AND share = 1) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base AND share = 1) AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label)
                 FILTER ((is_base AND share = 1) OR (NOT is_base AND share >= {share})) AS labels,
             max(share) AS score FROM sp GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN a USING (rid)"""
