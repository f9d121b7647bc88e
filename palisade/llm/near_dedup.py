"""Near-duplicate documents by MinHash: one-permutation hashing, optimal densification, bands, star edges.

1. Sketch. A document's set is its distinct word shingles, hashed to 64 bits. One hash function serves all bins:
   the high bits choose the bin, the least hash in a bin is its value. An empty bin takes the value of a bin that
   a 2-universal sequence picks for it (optimal densification), so bins agree with the sets' similarity as
   probability. ``ROWS`` bins make one of ``BANDS`` keys.
2. Equal sets are one node, whatever their number.
3. Candidates. In each bucket of a band key the least node is the hub and every other node gets one edge to it,
   so a bucket of n nodes gives n - 1 edges, and all buckets of a hub make one star.
4. Confirmation. The members of a star meet in tiles of two slices of about ``SLICE`` nodes. A tile cuts the texts into
   shingles again and counts all intersections of full sets as one product of 0/1 matrices; a link needs
   ``100 x intersection >= similarity x union``. Members are compared with each other as well as with the hub, so no
   link is lost behind a hub that has none. A tile gives at most one link per node: to the least node it reaches there.
5. Components by alternating stars.

A pair of similarity 0.8 misses all 75 bands of 9 rows with a probability of 2 in 100,000, one of 0.85 with 3 in a
billion; one of 0.3, as documents with a common passage may have, meets in a band with 1.5 in a thousand.

Defined cases: a null text or one without words has an empty set, no links and n_shingles 0; fewer words than a
shingle are one shingle; rows that repeat a doc_id keep sets of their own; rows without doc_id take part, and
their component has the least id of the others, or null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, id_key, numbered, stored
from .components import component_labels

BANDS, ROWS = 75, 9
BINS = BANDS * ROWS
SLICE = 512
#: Columns of the matrices that a tile multiplies.
_COLUMNS = 8192
#: Words whose hash a task keeps at hand, about 20 MB.
WORD_CACHE = 100_000
#: Texts that are Python objects at a time.
FEW = 256
_PICKS, _FIRST_PICKS = 512, 16

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hash of each word, computed once while the cache holds it."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes | None, width: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; fewer words than ``width`` are one shingle."""
    words = text.lower().split() if text else []  # on bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    n = len(h) - width + 1
    total = np.full(n, np.uint64(width))
    for i in range(width):
        total = _mix(total + h[i:i + n])  # ordered: each word enters a new round
    return np.unique(total)


def _picks(bins: int) -> np.ndarray:
    """For each bin the sequence of bins that an empty one asks for a value."""
    at = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(1_000_003) + np.arange(_PICKS, dtype=np.uint64)[None, :]
    return (_mix(at + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bins)).astype(np.int64)


PICKS = _picks(BINS)


def sketch(values: np.ndarray) -> np.ndarray:
    """One value for each bin of a non-empty sorted set of hashes."""
    bins = ((values >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    filled, first = np.unique(bins, return_index=True)
    out = np.zeros(BINS, np.uint64)
    has = np.zeros(BINS, bool)
    at = filled.astype(np.int64)
    out[at], has[at] = values[first], True
    if len(at) < BINS:
        empty = np.flatnonzero(~has)
        if len(at) == 1:
            out[empty] = out[at[0]]
            return out
        for picks in (PICKS[:, :_FIRST_PICKS], PICKS[:, _FIRST_PICKS:]):
            answers = has[picks[empty]]
            found = answers.any(axis=1)
            out[empty[found]] = out[picks[empty[found], answers[found].argmax(axis=1)]]
            empty = empty[~found]
            if not len(empty):
                break
        out[empty] = out[at[np.searchsorted(at, empty) % len(at)]]
    return out


_ODD = _mix(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def band_keys(values: np.ndarray) -> np.ndarray:
    rows = _mix(sketch(values).reshape(BANDS, ROWS) * _ODD)
    return _mix(rows.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, FEW):
            yield batch.slice(at, FEW)


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in _pieces(batches):
            n, digests, keys = [], [], []
            for text in _bytes(batch.column("text")):
                values = shingles(text, width, hashes)
                n.append(len(values))
                digests.append(xxhash.xxh3_128_digest(values.tobytes()) if len(values) else None)
                keys.append(band_keys(values) if len(values) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64()))], ["row", "id", "n_shingles", "digest", "keys"])

    return run


def tile_links(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the least position that it reaches over links among ``sets``; all pairs are compared exactly."""
    n, sizes = len(sets), np.array([len(x) for x in sets])
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    shared = count[column] > 1  # a shingle of one set is in no intersection
    column, owner = (np.cumsum(count > 1) - 1)[column[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.diag(sizes - np.bincount(owner, minlength=n)).astype(np.float64)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        low, high = np.searchsorted(column, (start, start + _COLUMNS))
        block = np.zeros((n, int(column[high - 1]) + 1 - start), np.float32)
        block[owner[low:high], column[low:high] - start] = 1
        common += block @ block.T
    linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    reached = np.arange(n)
    while True:
        least = np.where(linked, reached[None, :], n).min(axis=1)
        least = least[least]
        if (least == reached).all():
            return reached
        reached = least


def _confirm(width: int, percent: int):
    """Rows sorted by tile; the links of each tile leave when its last row has come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, tile, nodes, sets = WordHashes(), None, [], []

        def links():
            if len(sets) < 2:
                return [], []
            order = np.argsort(nodes)
            names = np.array(nodes)[order]
            least = tile_links([sets[i] for i in order], percent)
            far = np.flatnonzero(least != np.arange(len(least)))
            return names[far].tolist(), names[least[far]].tolist()

        for batch in _pieces(batches):
            u, v = [], []
            columns = [batch.column(c).to_pylist() for c in ("hub", "i", "j", "member")]
            for hub, i, j, member, text in zip(*columns, _bytes(batch.column("text"))):
                if (hub, i, j) != tile:
                    for all_of, some in zip((u, v), links()):
                        all_of += some
                    tile, nodes, sets = (hub, i, j), [], []
                nodes.append(member)
                sets.append(shingles(text, width, hashes))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
        u, v = links()
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _tiles() -> Column:
    """The tiles of a member: its slice with each other slice, or the only one."""
    return F.expr("""IF(slices = 1, array(struct(0 AS i, 0 AS j)), transform(filter(sequence(0, slices - 1), x -> x <> slice),
        x -> struct(least(x, slice) AS i, greatest(x, slice) AS j)))""")


def confirmed(docs: DataFrame, nodes: DataFrame, stars: DataFrame, width: int, percent: int) -> DataFrame:
    """u, v: links among the nodes of each star (hub, member) that join all that are similar enough over links.

    ``docs`` (row, text) has the text of each node at its ``first_row``.
    """
    hubs = stars.select("hub").distinct().select("hub", F.col("hub").alias("member"))
    edges = stored(stars.unionByName(hubs), "near-edges")
    degree = edges.groupBy("hub").agg(F.ceil(F.count("*") / F.lit(SLICE)).cast("int").alias("slices"))
    wanted = stored(edges.select(F.col("member").alias("node")).distinct()
                    .join(nodes.select("node", "first_row"), "node"), "near-wanted")
    # the rows alone are small enough to be sent to the scan for longer; beyond that Spark shuffles, or filters by Bloom
    rows = stored(wanted.select("first_row"), "near-rows")
    texts = (docs.select(F.col("row").alias("first_row"), "text").join(rows, "first_row", "left_semi")
             .join(wanted, "first_row").select("node", "text"))
    placed = (edges.join(degree, "hub")
              .withColumn("slice", F.pmod(F.xxhash64("member"), "slices").cast("int"))
              .select("hub", "member", F.inline(_tiles())))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = (placed.join(texts, F.col("member") == F.col("node")).select("hub", "i", "j", "member", "text")
           .repartition(parts, "hub", "i", "j").sortWithinPartitions("hub", "i", "j", "member"))
    return met.mapInArrow(_confirm(width, percent), "u long, v long")


def candidate_stars(nodes: DataFrame) -> DataFrame:
    """hub, member: one edge from the least node of each bucket of at least two to every other, each once."""
    filed = nodes.select("node", F.explode("keys").alias("key"))
    several = filed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top")
    return (filed.join(several.select("key", "hub"), "key").where("node <> hub")
            .select("hub", F.col("node").alias("member")).distinct())


def link_labels(docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """node, label of the nodes that have links."""
    return component_labels(confirmed(docs, nodes, candidate_stars(nodes), width, percent))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """row, id, n_shingles, component_id, keeper for each row of ``docs`` (doc_id, text).

    component_id: the least doc_id that can be reached over links. keeper: the one row of its group that stays,
    the row with that id. Rows without id carry the id NO_ID.
    """
    rows, row = numbered(docs.select("doc_id", "text"), "near-docs")
    return _grouped(rows.select(F.col(row).alias("row"), id_key().alias("id"), "text"), width, percent)


def _grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``near_duplicates`` of stored rows (row, id, text)."""
    cut = stored(docs.mapInArrow(
        _sketches(width), "row long, id long, n_shingles long, digest binary, keys array<long>"), "near-sketches")
    nodes = stored(cut.where("n_shingles > 0").groupBy("digest").agg(
        F.min("id").alias("first_id"), F.min("row").alias("first_row"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"))
        .withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    labels = link_labels(docs, nodes, width, percent)
    placed = stored(nodes.join(labels, "node", "left").select(
        "digest", "first_id", F.coalesce("label", "node").alias("label")), "near-placed")
    least = placed.groupBy("label").agg(F.min("first_id").alias("component_id"))
    ids = stored(placed.join(least, "label").select("digest", "label", "component_id"), "near-components")
    whole = cut.select("row", "id", "n_shingles", "digest").join(ids, "digest", "left").withColumn(
        "component_id", F.coalesce("component_id", "id"))
    own = (F.col("id") == F.col("component_id")) & (F.col("n_shingles") > 0)
    # by label: groups without any id, or of other texts under the same id, share a component_id
    first = whole.where(own).groupBy("label").agg(F.min("row").alias("row")).select(
        "row", F.lit(True).alias("first_row"))
    return whole.join(first, "row", "left").select(
        "row", "id", "n_shingles", "component_id",
        (F.coalesce("first_row", F.lit(False)) | (F.col("n_shingles") == 0)).alias("keeper"))


def digest_columns(found: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    plain = [F.when(F.col(c) != NO_ID, F.col(c)).alias(a) for c, a in (("id", "doc_id"), ("component_id", "component_id"))]
    return found.select(plain[0], "n_shingles", plain[1],
                        (F.col("id") == F.col("component_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group: the one with the least doc_id, or one row if none has a doc_id.

    Rows are dropped by a stored number, so another text under the doc_id of a dropped copy stays. Rows of a group
    that repeat its least doc_id all stay. Documents without words stay.
    """
    rows, row = numbered(docs, "near-docs")
    found = _grouped(rows.select(F.col(row).alias("row"), id_key().alias("id"), "text"), width, percent)
    repeat = (F.col("id") == F.col("component_id")) & (F.col("id") != NO_ID)
    gone = stored(found.where(~F.col("keeper") & ~repeat).select(F.col("row").alias("gone_row")), "near-gone")
    return rows.join(gone, rows[row] == gone["gone_row"], "left_anti").drop(row)


def oracle_sql(width: int = 4, percent: int = 80) -> str:
    """Exact links by counting shared shingles; components by repeated least labels."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_aggregate(list_slice(w, i + 1, i + {width}), 'string_agg', ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - {width}, 0) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g)
                            WHERE x.doc_id <> y.doc_id GROUP BY ALL) p
      JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM d UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) m ON m.node = d.doc_id"""
