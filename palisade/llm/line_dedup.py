"""Drop repeated lines across documents with a Bloom filter and an exact confirmation.

1. Each task hashes the keys of its lines; a hash leaves the task once, marked when the task met it twice.
2. Hashes meet by value. Each reducer streams them through a *once* filter: a hash that the filter already knows is
   a suspect, each time it comes again. A second filter must not silence those repeats, as its false positives would
   take suspects away. The filter has a fixed number of bits, so memory is bounded; a crowded one only adds suspects.
3. Lines with a suspected hash are confirmed by the SHA-256 of their whole key: first and last document per key,
   combined before the shuffle, so a line that every document holds costs one row per task.
4. Rows take up the keys that they lose, each its own, so a document of many rows gathers nothing in one place. A key
   meets its lines in ``SALTS`` parts, so the line that every document holds is not one task's work.

Key of a line: white space stripped at both ends, A-Z lower-cased. Keys shorter than ``min_chars`` stay.

Defined cases: a null or empty text is one empty line; rows that repeat a doc_id count as one document; rows
without doc_id count as one document behind all others; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, id_key, numbered, stored

MIN_CHARS = 10
FILTER_BITS = 1 << 26
PROBES = 3
#: Hashes that a task gathers before it passes them on.
GATHER = 200_000
#: Parts in which the lines of a key meet the decision on it.
SALTS = 16

_STRIP = WHITE.encode()


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """The SHA-256 of the key of each line, None for keys under ``min_chars`` code points."""
    out: list[bytes | None] = []
    for line in text.lower().split(b"\n"):  # bytes.lower() changes A-Z only
        key = line.strip(_STRIP)
        short = len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars)
        out.append(None if short else hashlib.sha256(key).digest())
    return out


def _texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def _seen_in_task(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, bool] = {}

        def flush():
            hashes = np.frombuffer(b"".join(seen), dtype="<i8")
            return pa.RecordBatch.from_arrays(
                [pa.array(hashes), pa.array(list(seen.values()), pa.bool_())], ["hash", "again"])

        for batch in batches:
            for text in _texts(batch, "text"):
                for key in {k[:8] for k in line_keys(text, min_chars) if k}:
                    seen[key] = key in seen
                if len(seen) >= GATHER:
                    yield flush()
                    seen.clear()
        if seen:
            yield flush()

    return run


class Bloom:
    """A Bloom filter over 64-bit hashes: ``PROBES`` bits by double hashing."""

    def __init__(self, bits: int):
        self.bits, self.words = bits, np.zeros(bits // 8, np.uint8)

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes.view(np.uint64)
        low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
        steps = np.arange(PROBES, dtype=np.uint64)[:, None]
        return ((low + steps * high) % np.uint64(self.bits)).astype(np.int64)

    def add(self, hashes: np.ndarray) -> None:
        at = self._places(hashes)
        np.bitwise_or.at(self.words, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = self._places(hashes)
        return ((self.words[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)


def _suspects(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = Bloom(bits)
        for batch in batches:
            values, first, count = np.unique(batch.column("hash").to_numpy(), return_inverse=True, return_counts=True)
            again = np.zeros(len(values), bool)
            np.logical_or.at(again, first, batch.column("again").to_numpy(zero_copy_only=False))
            repeated = again | (count > 1) | once.holds(values)
            once.add(values)
            yield pa.RecordBatch.from_arrays([pa.array(values[repeated])], ["hash"])

    return run


def suspected_hashes(docs: DataFrame, min_chars: int = MIN_CHARS, bits: int = FILTER_BITS) -> DataFrame:
    """hash, perhaps several times, of every line key that may stand in more than one document; no repeated key is missing."""
    seen = docs.select("text").mapInArrow(_seen_in_task(min_chars), "hash long, again boolean")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return seen.repartition(parts, "hash").mapInArrow(_suspects(bits), "hash long")


def _lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys = [], []
            for text in _texts(batch, "text"):
                own = {k for k in line_keys(text, min_chars) if k}
                keys.extend(own)
                sizes.append(len(own))
            of = pa.array(np.repeat(np.arange(len(sizes)), np.array(sizes, np.int64)))
            hashes = np.frombuffer(b"".join(k[:8] for k in keys), dtype="<i8")
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(of), batch.column("doc").take(of), pa.array(hashes), pa.array(keys, pa.binary())],
                ["row", "doc", "hash", "key"])

    return run


def lost_keys(docs: DataFrame, row: str, min_chars: int = MIN_CHARS, bits: int = FILTER_BITS) -> DataFrame:
    """lost_row, keys: the key digests whose lines each row of ``docs`` (``row``, doc_id, text) loses."""
    suspects = stored(suspected_hashes(docs, min_chars, bits), "line-suspects")
    lines = (docs.select(F.col(row).alias("row"), id_key().alias("doc"), "text")
             .mapInArrow(_lines(min_chars), "row long, doc long, hash long, key binary")
             .join(suspects.distinct(), "hash", "left_semi").select("row", "doc", "key"))
    lines = stored(lines, "line-suspected")
    repeats = (lines.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
               .where("first < last").select("key", "first"))
    repeats = repeats.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    lost = lines.withColumn("salt", F.pmod("row", F.lit(SALTS))).join(repeats, ["key", "salt"]).where("doc > first")
    return lost.groupBy(F.col("row").alias("lost_row")).agg(F.collect_set("key").alias("keys"))


def _rewrite(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, keys in zip(_texts(batch, "text"), batch.column("keys").to_pylist()):
                lines = text.split(b"\n")
                n_lines.append(len(lines))
                if keys:
                    lost = set(keys)
                    lines = [x for x, k in zip(lines, line_keys(text, min_chars)) if k not in lost]
                    text = b"\n".join(lines)
                n_dropped.append(n_lines[-1] - len(lines) if keys else 0)
                kept.append(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_text"])

    return run


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, n_lines (before), n_dropped, kept_text for each row of ``docs`` (doc_id, text)."""
    docs, row = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "line-rows")
    lost = stored(lost_keys(docs, row, min_chars, bits), "line-lost")
    joined = docs.join(lost, F.col(row) == F.col("lost_row"), "left").select("doc_id", "text", "keys")
    return joined.mapInArrow(_rewrite(min_chars), "doc_id long, n_lines long, n_dropped long, kept_text string")
