"""SimHash fingerprints of whole texts, and the search for all fingerprints within a Hamming radius.

A text's terms are its words and its pairs of neighbouring words. Each term's 64-bit hash votes with the term's
weight on every bit, for or against; the signs are the fingerprint. Pairs say more about a text than single
words, so they weigh more, and a term that repeats weighs 1 + ln(count). Two fingerprints that differ in h of 64
bits stand for an angle of pi x h / 64; the likeness is its cosine, and 0 beyond a right angle.

Search: the bits are cut into ``radius + spare`` blocks. Fingerprints within the radius agree on some ``spare``
blocks, so each choice of that many blocks is a table, keyed by their bits, in which they meet.

Defined cases: a null text is empty; texts without words have fingerprint 0, like each other (1) and no other
text (0); rows that repeat a doc_id are ordered by their text; a row without id comes last; with a single row
the next row is the row itself; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_key, stored
from .near_dedup import WordHashes, _mix

BITS = 64
PAIR_WEIGHT, WORD_WEIGHT = 1.0, 0.25
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_BIT_SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2 - 1)
_BYTE_AT = np.arange(8) * 256


def fingerprint(text: bytes, hashes: WordHashes) -> int | None:
    """64 signed votes of the weighted terms; None without words."""
    words = _WORD.findall(text.lower())
    if not words:
        return None
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    terms = np.concatenate([_mix(h), _mix(_mix(h[:-1]) + h[1:])])
    terms, count = np.unique(terms, return_counts=True)
    single = np.isin(terms, _mix(h), assume_unique=False) if len(words) > 1 else np.ones(len(terms), bool)
    weight = (1.0 + np.log(count)) * np.where(single, WORD_WEIGHT, PAIR_WEIGHT)
    # votes by byte value: 8 x 256 sums instead of 64 per term
    at = terms.byteswap().view(np.uint8).reshape(-1, 8) + _BYTE_AT
    sums = np.bincount(at.ravel(), np.repeat(weight, 8), 2048).reshape(8, 256)
    return int.from_bytes(np.packbits((sums @ _BIT_SIGNS).ravel() > 0).tobytes(), "big")


def likeness(a: int | None, b: int | None) -> float:
    if a is None or b is None:
        return float(a is b)
    return max(0.0, float(np.cos(np.pi * (a ^ b).bit_count() / BITS)))


def edited(text: str, following: str) -> str:
    """The last quarter of ``text`` replaced by the start of ``following``."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def _hex(value: int | None) -> str:
    return f"{value or 0:016x}"


_RESULT = (("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
           ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()))
_EDGE = (("part", pa.int32()), ("edge", pa.string()), ("text", pa.string()))
_SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")
_EDGE_SCHEMA = ", part int, edge string, text string"


def _compared(doc: int | None, text: str, own: int | None, following: str, next_print: int | None,
              hashes: WordHashes) -> tuple:
    changed = edited(text, following)
    raw = changed.encode()
    other = own if changed == text else fingerprint(raw, hashes)
    return (doc, len(text), hashlib.sha256(raw).hexdigest(), _hex(own), _hex(other), likeness(own, other),
            likeness(own, next_print))


def _batch(rows: list[tuple], fields) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each row of an ordered partition with the next. The partition's first text leaves as its "head",
    its last row, which cannot be finished here, as its "tail"."""
    hashes, last = WordHashes(), None  # last: part, id, text, fingerprint
    for batch in batches:
        out: list[tuple] = []
        texts = batch.column("text").to_pylist()
        for part, doc, text in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), texts):
            text = text or ""
            own = fingerprint(text.encode(), hashes)
            if last is None:
                out.append((*[None] * 7, part, "head", text))
            else:
                out.append((*_compared(last[1], last[2], last[3], text, own, hashes), last[0], None, None))
            last = (part, doc, text, own)
        yield _batch(out, _RESULT + _EDGE)
    if last:
        yield _batch([(last[1], *[None] * 6, last[0], "tail", last[2])], _RESULT + _EDGE)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        out = []
        for doc, text, following in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "following")]):
            own, other = fingerprint(text.encode(), hashes), fingerprint(following.encode(), hashes)
            out.append(_compared(doc, text, own, following, other, hashes))
        yield _batch(out, _RESULT)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of ``docs`` (doc_id, text), of their edited texts, and the likeness to both and to the next row.

    Rows are range-partitioned by (id, hash of the text), so texts are shuffled once, and each partition is walked
    in order. Only the last row of a partition meets its next text in a second step, by the number of the next
    partition that has rows; after the last one comes the first.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", id_key().alias("id"),
                        F.xxhash64("text").alias("tie"))
    walked = (keyed.repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie")
              .select("doc_id", "text", F.spark_partition_id().alias("part"))
              .mapInArrow(_walk, _SCHEMA + _EDGE_SCHEMA))
    walked = stored(walked, "fingerprints")
    heads = walked.where("edge = 'head'").select("part", F.col("text").alias("following"))
    numbers = heads.select("part")
    order = Window.orderBy("part")  # one number per partition
    after = numbers.select(F.col("part").alias("from_part"), F.coalesce(
        F.lead("part").over(order),
        F.first("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("to_part"))
    tails = (walked.where("edge = 'tail'").select("doc_id", "text", "part")
             .join(after, F.col("part") == F.col("from_part")).drop("part")
             .join(heads, F.col("to_part") == F.col("part")).select("doc_id", "text", "following"))
    names = [n for n, _ in _RESULT]
    return walked.where("edge IS NULL").select(*names).unionByName(tails.mapInArrow(_finish, _SCHEMA))


def _tables(radius: int, spare: int) -> list[list[tuple[int, int]]]:
    """For each choice of ``spare`` of the ``radius + spare`` blocks: the (shift, width) of its blocks."""
    n = radius + spare
    cuts = [round(i * BITS / n) for i in range(n + 1)]
    blocks = [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(n)]
    return [list(choice) for choice in combinations(blocks, spare)]


def near_fingerprints(prints: DataFrame, radius: int = 3, spare: int = 3) -> DataFrame:
    """a, b, distance: all pairs of different fingerprints (hex, column ``fingerprint``) within ``radius`` bits.

    Equal fingerprints are one row here, so copies cost nothing; a pair that meets in several tables is one row.
    """
    value = F.conv(F.col("fingerprint"), 16, -10).cast("long")
    distinct = prints.select("fingerprint").distinct().select("fingerprint", value.alias("value"))
    tables = []
    for number, blocks in enumerate(_tables(radius, spare)):
        mask = sum(((1 << width) - 1) << shift for shift, width in blocks)
        mask = mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask
        tables.append(F.struct(F.lit(number).alias("number"), F.col("value").bitwiseAND(F.lit(mask)).alias("bits")))
    filed = distinct.select("fingerprint", "value", F.inline(F.array(*tables)))
    other = filed.select(F.col("fingerprint").alias("b"), F.col("value").alias("other"), "number", "bits")
    distance = F.bit_count(F.col("value").bitwiseXOR(F.col("other")))
    return (filed.withColumnRenamed("fingerprint", "a").join(other, ["number", "bits"])
            .where((F.col("a") < F.col("b")) & (distance <= radius))
            .select("a", "b", distance.cast("int").alias("distance")).distinct())
