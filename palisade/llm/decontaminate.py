"""Benchmark decontamination on a positional inverted index, in DataFrame expressions only.

``build_index`` stores the postings (term, row, position) of the training documents: every term that a query set
holds, over whole texts. A phrase is looked up from its rarest terms: the posting lists of its two rarest terms,
each shifted by the term's offset in the phrase, are intersected; the few places left are probed for all other
terms of the phrase. Terms are compared exactly, so the result is exact.

Everything that is joined without a shuffle is a stored table whose size Spark knows; above its broadcast limit
the same joins shuffle, by term or by (row, position). No list of places is gathered in one row.

Defined cases: a null text has no words; rows that repeat a doc_id are searched each for itself; an item of no
words has no window; items without id are the item "null", rows that repeat an item_id are one item; empty
tables give no rows, or rows without hits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, RAW_WORD, UPPER, ascii_lower, numbered, stored

WINDOW = 10
#: The term of each document's end, which holds its number of words as the position.
END = -1


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RAW_WORD), F.lit(0))


@dataclass(frozen=True)
class Index:
    """vocabulary: term_id, term. postings: term_id, row, position, doc_id (on the end's rows only)."""

    vocabulary: DataFrame
    postings: DataFrame

    def lengths(self) -> DataFrame:
        return self.postings.where(F.col("term_id") == END).select("row", "doc_id", F.col("position").alias("n_words"))

    def frequencies(self) -> DataFrame:
        return self.postings.where(F.col("term_id") != END).groupBy("term_id").count()


def build_index(docs: DataFrame, terms: DataFrame) -> Index:
    """Index the words of ``docs`` (doc_id, text) that stand in ``terms`` (term, A-Z lower-cased).

    Words outside the query set's vocabulary can be in no phrase of it and get no posting.
    """
    spark = docs.sparkSession
    named = terms.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id())
    end = spark.sql(f"SELECT '' AS term, CAST({END} AS BIGINT) AS term_id")
    vocabulary = stored(named.unionByName(end).withColumn("folded", F.lower("term")), "index-terms")
    tokens = (docs.select("doc_id", F.array_append(words_of(F.col("text")), F.lit("")).alias("words"))
              .withColumn("row", F.monotonically_increasing_id())
              .select("row", "doc_id", F.posexplode("words").alias("position", "word"))
              .withColumn("folded", F.lower("word")))
    postings = (tokens.join(vocabulary, "folded").where(ascii_lower(F.col("word")) == F.col("term"))
                .select("term_id", "row", "position", F.when(F.col("term_id") == END, F.col("doc_id")).alias("doc_id")))
    return Index(vocabulary, stored(postings, "index-postings"))


def item_words(items: DataFrame) -> DataFrame:
    """item, words of each item that has words."""
    return (items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"),
                         F.transform(words_of(F.col("text")), ascii_lower).alias("words"))
            .where(F.size("words") > 0))


def item_windows(items: DataFrame, width: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(phrase_id, words) of the distinct windows and (phrase_id, item) of the items that have them."""
    last = F.greatest(F.size("words") - F.lit(width), F.lit(0))
    windows = item_words(items).select(
        "item", F.explode(F.transform(F.sequence(F.lit(0), last),
                                      lambda i: F.slice("words", i + 1, width))).alias("words")).distinct()
    phrases = stored(windows.select("words").distinct().withColumn("phrase_id", F.monotonically_increasing_id()),
                     "index-phrases")
    return phrases, windows.join(phrases, "words").select("phrase_id", "item")


def phrase_terms(index: Index, phrases: DataFrame) -> DataFrame:
    """phrase_id, offset, term_id, width, rank (1: the rarest), of the phrases whose terms all occur."""
    spread = (phrases.select("phrase_id", F.size("words").alias("width"), F.posexplode("words").alias("offset", "term"))
              .join(index.vocabulary.select("term", "term_id"), "term")
              .join(index.frequencies(), "term_id"))
    one = Window.partitionBy("phrase_id")
    ranked = (spread.withColumn("found", F.count("*").over(one)).where("found = width")
              .withColumn("rank", F.row_number().over(one.orderBy("count", "offset"))))
    return stored(ranked.select("phrase_id", "offset", "term_id", "width", "rank"), "index-phrase-terms")


def _list(index: Index, terms: DataFrame, rank: int) -> DataFrame:
    """The postings of the phrases' terms of ``rank``, shifted to the phrase's start."""
    return (index.postings.select("term_id", "row", "position").join(terms.where(F.col("rank") == rank), "term_id")
            .select("phrase_id", "row", (F.col("position") - F.col("offset")).alias("start"), "width")
            .where("start >= 0"))


def phrase_matches(index: Index, phrases: DataFrame) -> DataFrame:
    """phrase_id, row, start, width of every place where a phrase (phrase_id, words) stands."""
    terms = phrase_terms(index, phrases)
    key = ["phrase_id", "row", "start", "width"]
    places = _list(index, terms, 1)
    both = places.where("width > 1").join(_list(index, terms, 2), key, "left_semi")
    open_places = stored(both.where("width > 2"), "index-places")
    probes = (open_places.join(terms.where("rank > 2").select("phrase_id", "offset", "term_id"), "phrase_id")
              .withColumn("position", F.col("start") + F.col("offset")))
    near = index.postings.select("term_id", "row", "position").join(
        stored(open_places.select("row").distinct(), "index-rows"), "row", "left_semi")
    full = (probes.join(near, ["row", "position", "term_id"]).groupBy(*key).count()
            .where("count = width - 2").select(*key))
    return places.where("width = 1").unionByName(both.where("width = 2")).unionByName(full)


def proximity_matches(index: Index, queries: DataFrame, slop: int = 5) -> DataFrame:
    """query_id, row, position: where all terms of a query (query_id, terms) stand within ``slop`` words of its rarest.

    Positions are cut into blocks of ``slop`` words, so a term can only be in the rarest term's block or beside it.
    """
    phrases = queries.select(F.col("query_id").alias("phrase_id"), F.array_distinct("terms").alias("words"))
    terms = phrase_terms(index, phrases)
    block = F.floor(F.col("position") / F.lit(slop + 1)).cast("long")
    anchors = index.postings.select("term_id", "row", "position").join(terms.where("rank = 1"), "term_id").select(
        "phrase_id", "row", F.col("position").alias("at"), "width", block.alias("block"))
    around = anchors.withColumn("block", F.explode(F.array(*[F.col("block") + i for i in (-1, 0, 1)])))
    wanted = around.join(terms.select("phrase_id", "term_id"), "phrase_id")
    there = index.postings.select("term_id", "row", "position", block.alias("block"))
    return (wanted.join(there, ["row", "block", "term_id"]).where(F.abs(F.col("position") - F.col("at")) <= slop)
            .groupBy("phrase_id", "row", "at", "width").agg(F.count_distinct("term_id").alias("n"))
            .where("n = width").select(F.col("phrase_id").alias("query_id"), "row", F.col("at").alias("position")))


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, contaminated for each row of ``docs``; items: sorted, comma-joined."""
    phrases, owners = item_windows(items, width)
    index = build_index(docs, phrases.select(F.explode("words").alias("term")))
    places = stored(phrase_matches(index, phrases), "index-hits")
    # covered words: each place adds what lies behind the furthest end so far
    spans = places.select("row", "start", (F.col("start") + F.col("width")).alias("end")).distinct()
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    n_hit = spans.withColumn("fresh", fresh).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    found = (places.select("row", "phrase_id").distinct().join(owners, "phrase_id").groupBy("row")
             .agg(F.sort_array(F.collect_set("item")).alias("found")))
    return (index.lengths().join(n_hit, "row", "left").join(found, "row", "left").select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.when(F.col("found").isNull(), 0).otherwise(F.size("found")).cast("long").alias("n_items"),
        F.coalesce(F.array_join("found", ","), F.lit("")).alias("items"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated")))


def without_contaminated(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold a window; other rows of the same doc_id, or without one, stay."""
    rows, row = numbered(docs, "contamination-rows")
    hit = contamination(rows.select(F.col(row).alias("doc_id"), "text"), items, width).where("contaminated").select(
        F.col("doc_id").alias("hit_row"))
    hit = stored(hit, "contaminated-rows")
    return rows.join(hit, rows[row] == hit["hit_row"], "left_anti").drop(row)


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS width, list_slice(w, i + 1, i + least(len(w), {WINDOW})) AS g
       FROM (SELECT item, w, unnest(range(0, greatest(len(w) - {WINDOW}, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
widths AS (SELECT DISTINCT width FROM bw),
dw AS (SELECT rid, width, i, list_slice(w, i + 1, i + width) AS g
       FROM (SELECT rid, w, width, unnest(range(0, len(w) - width + 1)) AS i FROM d, widths WHERE len(w) >= width)),
hits AS (SELECT rid, i, dw.width, item FROM dw JOIN bw ON dw.width = bw.width AND dw.g = bw.g),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit
            FROM (SELECT rid, unnest(range(i, i + width)) AS p FROM hits) GROUP BY rid),
found AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items
          FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN found USING (rid)"""
