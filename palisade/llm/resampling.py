"""Importance resampling of documents towards a target distribution of hashed word n-grams.

A feature is a run of 1 to ``longest`` consecutive words; its bucket is the CRC-32 of its words, joined by a space,
modulo ``n_buckets``. A bucket gains the log ratio of its smoothed shares in the target and in the documents, a
document weighs the mean gain of its features, and Gumbel noise drawn from its id turns the highest scores into a
draw without replacement in proportion to the exponential of the weight.

Batch concatenation: the texts of a slice are joined with a separator, one pass of a regular expression finds all
words, a binary search in the offsets of the texts gives every word its document and masks the n-grams that would
cross from one document into the next, and ``bincount`` adds up the rest. The pass is taken in blocks, so a text of
any length needs bounded memory. The CRC of a run follows from the CRCs of its words: appending bytes is linear.

Two passes read the texts, one for the counts of the buckets, one for the weights; between them only the
``n_buckets`` sums meet at the driver. Ranks come from range partitions and their counts.

Defined cases: a null text has no words, no features and weight 0; a null id is the empty key and comes after all
others in a tie; rows that repeat an id have their own weights and the same noise; a share of the rows is rounded
down; an empty target is all smoothing; an empty table gives no rows; other columns may have any name.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import LOWER, UPPER, fresh, id_key, numbered, stored
from .sharding import with_slots

N_BUCKETS, LONGEST = 10_000, 2
SEED, PERCENT, MIN_WORDS = 7, 25, 20
#: Bytes of text that are joined, and words that are handled at once.
SLICE, BLOCK = 1 << 22, 1 << 18
#: Words whose sums a task keeps at hand.
CACHE = 500_000
SEPARATOR = b"\n"
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


class WordSums(dict):
    """CRC-32 of each word (low half) and of the word after a space (high half), filled when a word is first met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = zlib.crc32(word) | zlib.crc32(word, zlib.crc32(b" ")) << 32
        return value


def _through(tables: np.ndarray, sums: np.ndarray) -> np.ndarray:
    return (tables[0][sums & 255] ^ tables[1][sums >> 8 & 255] ^ tables[2][sums >> 16 & 255] ^ tables[3][sums >> 24])


@cache
def _zeros(power: int) -> np.ndarray:
    """What 2**power zero bytes after a text make of its CRC, byte by byte of the CRC."""
    if power:
        half = _zeros(power - 1)
        return np.stack([_through(half, t) for t in half])
    byte = np.array([zlib.crc32(bytes([v])) ^ zlib.crc32(b"\0") for v in range(256)], np.uint32)
    value = np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    return byte[value & 255] ^ (value >> 8)


def appended(sums: np.ndarray, more: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC of texts with CRC ``sums`` followed by texts with CRC ``more`` and ``length`` bytes."""
    out = sums.copy()
    for power in range(int(length.max(initial=0)).bit_length()):
        chosen = np.flatnonzero(length >> power & 1)
        out[chosen] = _through(_zeros(power), out[chosen])
    return out ^ more


def feature_buckets(texts: Sequence[bytes], sums: WordSums, n_buckets: int = N_BUCKETS, longest: int = LONGEST,
                    ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, number of the text, bucket) of all runs of n words of ``texts``, in blocks."""
    ends = np.cumsum([len(t) + len(SEPARATOR) for t in texts])
    found = _WORD.finditer(SEPARATOR.join(texts).lower())
    kept = [np.empty(0, t) for t in (np.int64, np.uint32, np.uint32, np.int64)]  # of the last words of the block before
    while block := list(islice(found, BLOCK)):
        both = np.fromiter((sums[m.group()] for m in block), np.uint64, len(block))
        span = np.fromiter((x for m in block for x in m.span()), np.int64, 2 * len(block)).reshape(-1, 2)
        new = (np.searchsorted(ends, span[:, 0], side="right"), both.astype(np.uint32), (both >> np.uint64(32)).astype(np.uint32),
               span[:, 1] - span[:, 0] + 1)
        before = len(kept[0])
        doc, crc, spaced, length = (np.concatenate(x) for x in zip(kept, new))
        yield 1, doc[before:], crc[before:] % np.uint32(n_buckets)
        run = crc
        for n in range(2, min(longest, len(doc)) + 1):
            run = appended(run[:-1], spaced[n - 1:], length[n - 1:])
            first = max(0, before - n + 1)  # runs that end before this block were given with the last one
            own = first + np.flatnonzero(doc[first:len(doc) - n + 1] == doc[first + n - 1:])
            yield n, doc[own], run[own] % np.uint32(n_buckets)
        last = max(0, len(doc) - longest + 1)
        kept = [x[last:] for x in (doc, crc, spaced, length)]


def _sliced(texts: list[bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about ``SLICE`` bytes in all, with the number of the first."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text or b"")
        size += len(held[-1])
        if size >= SLICE:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def _binary_text(docs: DataFrame, *keep: str) -> DataFrame:
    return docs.select(*keep, F.col("text").cast("binary").alias(fresh(docs.select(*keep), "text")))


def bucket_counts(docs: DataFrame, n_buckets: int = N_BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of all ``docs`` lie in each bucket. Each task sends at most one row a bucket."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = np.zeros(n_buckets, np.int64), WordSums()
        for batch in batches:
            for _, texts in _sliced(batch.column(0).to_pylist()):
                for _, _, bucket in feature_buckets(texts, sums, n_buckets, longest):
                    total += np.bincount(bucket, minlength=n_buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    counts = np.zeros(n_buckets, np.int64)
    rows = _binary_text(docs).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for bucket, n in rows.collect():  # at most n_buckets rows
        counts[bucket] = n
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares, rounded down."""
    size, all_s, all_t = float(len(source)), float(source.sum()), float(target.sum())
    ratio = (target + 1.0) * (all_s + size) / ((source + 1.0) * (all_t + size))
    return np.array([math.floor(1000.0 * math.log(r)) for r in ratio], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` with n_words, n_features and weight, the floored mean gain of the features."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # n_buckets numbers

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, sums = shared.value.astype(np.float64), WordSums()
        for batch in batches:
            n_words, n_features, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for first, texts in _sliced(batch.column(batch.num_columns - 1).to_pylist()):
                here = slice(first, first + len(texts))
                for n, doc, bucket in feature_buckets(texts, sums, len(gain), longest):
                    count = np.bincount(doc, minlength=len(texts))
                    n_features[here] += count
                    n_words[here] += count if n == 1 else 0
                    total[here] += np.bincount(doc, gain[bucket], len(texts)).astype(np.int64)  # exact: whole numbers
            arrays = [pa.array(x) for x in (n_words, n_features, total // np.maximum(n_features, 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], [*batch.schema.names[:-1], "n_words", "n_features", "weight"])

    kept = docs.select(*keep).schema.fields
    return _binary_text(docs, *keep).mapInArrow(
        weigh, StructType([*kept, *(StructField(c, LongType()) for c in ("n_words", "n_features", "weight"))]))


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel draw from the id, rounded down."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED,
           n_buckets: int = N_BUCKETS, longest: int = LONGEST, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` of every row of ``docs`` (doc_id, text) with n_words, n_features, weight, score and rank.

    Of the rows with at least ``min_words`` words ``percent`` in a hundred are drawn, by score and then by id; the
    others have no rank. ``target`` needs a text. ``keep`` must hold doc_id and none of the names given here.
    """
    gain = gains(*(bucket_counts(x, n_buckets, longest) for x in (docs, target)))
    scored = weights(docs, gain, longest, keep).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = stored(scored, "resampling-scores")
    eligible = F.col("n_words") >= min_words
    drawn = scored.where(eligible).count() * percent // 100
    order = (scored.where(eligible).withColumn("group", F.lit(0)).withColumn("by_score", -F.col("score"))
             .withColumn("by_id", id_key()))
    order = with_slots(order, "group", ["by_score", "by_id"], "rank").drop("group", "by_score", "by_id")
    return order.withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1)).unionByName(
        scored.where(~eligible).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns."""
    rows, row = numbered(docs, "resampling-rows")
    slim = rows.select("doc_id", "text", F.col(row).alias("drawn_row"))
    chosen = ranked(slim, target, keep=("doc_id", "drawn_row"), **options).where(F.col("rank").isNotNull())
    return rows.join(chosen.select("drawn_row"), F.col(row) == F.col("drawn_row"), "left_semi").drop(row)


_FEATURES = rf"""SELECT {{key}}, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS feature
  FROM (SELECT {{key}}, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM {{table}})"""

ORACLE_SQL = f"""
WITH d AS ({_FEATURES.format(key="doc_id", table="documents")}), b AS ({_FEATURES.format(key="item_id", table="benchmark")}),
crc AS (SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)
                    ORDER BY n) AS steps FROM (SELECT unnest(range(256)) AS n)),
f AS (SELECT feature, list_transform(regexp_extract_all(hex(encode(feature)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes
      FROM (SELECT feature FROM d UNION SELECT feature FROM b)),
h AS (SELECT feature, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes),
             lambda c, x: xor(steps[(xor(c, x) & 255) + 1], c >> 8))) % {N_BUCKETS} AS bucket FROM f, crc),
s AS (SELECT bucket, count(*) AS s FROM d JOIN h USING (feature) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN h USING (feature) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM d) + {N_BUCKETS}.0::DOUBLE)
        / ((s + 1.0::DOUBLE) * ((SELECT count(*) FROM b) + {N_BUCKETS}.0::DOUBLE)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT doc_id, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight
      FROM d JOIN h USING (feature) JOIN g USING (bucket) GROUP BY doc_id),
r AS (SELECT o.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || o.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE)
          / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM documents o LEFT JOIN w USING (doc_id)),
p AS (SELECT *, n_features >= {2 * MIN_WORDS - 1} AS enough, row_number() OVER (PARTITION BY n_features >= {2 * MIN_WORDS - 1}
        ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= {2 * MIN_WORDS - 1}) AS n FROM r)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
       CASE WHEN enough AND place <= {PERCENT} * n // 100 THEN place END AS rank FROM p"""
