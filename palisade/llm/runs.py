"""Maximal periodic runs of words, and texts with the repeats of every run cut out.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends, at least
``min_length`` words and ``exponent`` periods long.

Descending-LCP Kruskal: neighbours in the suffix array of a document, taken by decreasing length l of their common
prefix, unite the classes of suffixes that share l words; a class keeps its positions in order. Two positions that
become neighbours in a class at a distance d within l (for higher exponents, within l / (exponent - 1)) begin a stretch
of period d and length d + l. Only its leftmost position counts, and only pairs that no equal class member parts, so
every run is found once and with its smallest period.

The suffix array is built by prefix doubling over many documents at once, on the positions that still share their
prefix; ranks of every doubling step give the common prefix lengths. Positions that share fewer words with any other
than the shortest run needs never enter a class, nor do groups whose positions all lie further apart than their longest
common prefix allows.

A document is the unit of work; a task handles documents of ``WORDS`` words together, or one longer document.

Defined cases: a null or empty text has no words, no runs and an empty collapsed text; words are separated by ASCII
white space; rows that repeat an id are each scanned; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import fresh

MIN_LENGTH, EXPONENT = 6, 4
WORDS = 400_000
RUN = StructType([StructField(c, LongType(), False) for c in ("start", "length", "period")])

Run = tuple[int, int, int]


def _doubled(symbols: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """Ranks of all positions by their first 1, 2, 4... words; equal ranks share them and their document.

    The last array has no equal ranks.
    """
    n = len(symbols)
    order = np.lexsort((symbols, doc))
    first = np.ones(n, bool)
    first[1:] = (symbols[order[1:]] != symbols[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
    rank = np.empty(n, np.int32)
    starts = np.flatnonzero(first)
    rank[order] = starts[np.cumsum(first) - 1]
    sizes = np.diff(starts, append=n)
    active = order[np.repeat(sizes > 1, sizes)]  # positions in groups of two and more
    levels, h = [rank], 1
    while len(active):
        ahead = active + h
        inside = ahead < n
        inside[inside] = doc[ahead[inside]] == doc[active[inside]]
        following = np.where(inside, rank[np.minimum(ahead, n - 1)], -1)
        order = np.lexsort((following, rank[active]))
        active, following = active[order], following[order]
        old = rank[active]
        head = np.ones(len(active), bool)
        head[1:] = old[1:] != old[:-1]
        first = head.copy()
        first[1:] |= following[1:] != following[:-1]
        starts = np.flatnonzero(first)
        of_group = np.maximum.accumulate(np.where(head, np.arange(len(active)), 0))
        rank = rank.copy()
        rank[active] = old + np.repeat(starts - of_group[starts], np.diff(starts, append=len(active)))
        levels.append(rank)
        sizes = np.diff(starts, append=len(active))
        active = active[np.repeat(sizes > 1, sizes)]
        h *= 2
    return levels


def _common_prefix(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the suffixes at ``a`` and ``b`` share."""
    n, out = len(levels[0]), np.zeros(len(a), np.int64)
    for power in range(len(levels) - 1, -1, -1):
        x, y = a + out, b + out
        inside = (x < n) & (y < n)
        same = np.zeros(len(a), bool)
        same[inside] = levels[power][x[inside]] == levels[power][y[inside]]
        out[same] += 1 << power
    return out


def _edges(levels: list[np.ndarray], least: int, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions in suffix order, the edges between neighbours with a common prefix of ``least`` words, and its length.

    Groups of neighbours that cannot hold a run are left out.
    """
    none = np.empty(0, np.int64)
    short = levels[min(len(levels) - 1, least.bit_length() - 1)]  # of the last power of two within least
    counts = np.bincount(short, minlength=len(short))
    at = np.flatnonzero(counts[short] > 1)
    if not len(at):
        return none, none, none, none
    at = at[np.argsort(levels[-1][at], kind="stable")]
    lcp = _common_prefix(levels, at[:-1], at[1:])
    lcp[short[at[:-1]] != short[at[1:]]] = 0
    joined = lcp >= least
    group = np.concatenate([[0], np.cumsum(~joined)])
    order = np.lexsort((at, group))
    gap, same = np.diff(at[order]), np.diff(group[order]) == 0
    n_groups = int(group[-1]) + 1
    nearest, longest = np.full(n_groups, np.iinfo(np.int64).max), np.zeros(n_groups, np.int64)
    np.minimum.at(nearest, group[order][1:][same], gap[same])
    np.maximum.at(longest, group[1:][joined], lcp[joined])
    open_groups = nearest <= longest // (exponent - 1)
    edge = np.flatnonzero(joined & open_groups[group[1:]])
    edge = edge[np.argsort(-lcp[edge], kind="stable")]
    return at, edge, edge + 1, lcp[edge]


def _unite(at: list[int], left: list[int], right: list[int], lcp: list[int], leftmost: Callable[[int, int], bool],
           min_length: int, exponent: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of all runs, the edges coming by decreasing ``lcp``."""
    parent: dict[int, int] = {}
    members: dict[int, list[int]] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    def still_neighbours(found: list[tuple[int, int, int]], level: int) -> Iterator[tuple[int, int, int]]:
        for node, i, j in found:
            positions = members[root(node)]
            if positions[bisect_left(positions, i) + 1] == j:
                yield i, j - i + level, j - i

    level, found = 0, []
    for a, b, length in zip(left, right, lcp):
        if length != level:
            yield from still_neighbours(found, level)
            level, found = length, []
        near = length // (exponent - 1)
        a, b = root(a), root(b)
        big, small = members.get(a) or [at[a]], members.pop(b, None) or [at[b]]
        if len(big) < len(small):
            big, small = small, big
        before, last = -1, None
        pairs = []
        for p in small:  # the neighbours of p in the other class, if no smaller or greater p lies between
            place = bisect_left(big, p)
            if place != before:
                if last is not None and before < len(big):
                    pairs.append((last, big[before]))
                if place:
                    pairs.append((big[place - 1], p))
            before, last = place, p
        if before < len(big):
            pairs.append((last, big[before]))
        found.extend((a, i, j) for i, j in pairs if j - i <= near and j - i + length >= min_length and leftmost(i, j))
        if len(small) < 8:
            for p in small:
                big.insert(bisect_left(big, p), p)
        else:
            big.extend(small)
            big.sort()
        parent[b] = a
        members[a] = big
    yield from still_neighbours(found, level)


def runs_of(texts: list[list[bytes]], min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> list[list[Run]]:
    """The runs (start, length, period) of each list of words, by start and period."""
    out: list[list[Run]] = [[] for _ in texts]
    number: dict[bytes, int] = defaultdict(count().__next__)
    sizes = np.array([len(t) for t in texts], np.int64)
    total = int(sizes.sum())
    if not total:
        return out
    symbols = np.fromiter((number[w] for t in texts for w in t), np.int32, total)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    begin = np.cumsum(sizes) - sizes
    # the shortest common prefix of a run's first two periods
    least = min(max(min_length - q, (exponent - 1) * q) for q in range(1, min_length + 1))
    at, left, right, lcp = _edges(_doubled(symbols, doc), least, exponent)
    if not len(left):
        return out

    def leftmost(i: int, j: int) -> bool:
        return i == begin[doc[i]] or symbols[i - 1] != symbols[j - 1]

    for start, length, period in _unite(at.tolist(), left.tolist(), right.tolist(), lcp.tolist(), leftmost, min_length, exponent):
        d = int(doc[start])
        out[d].append((start - int(begin[d]), length, period))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """``words`` without those that any run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def scan_runs(docs: DataFrame, min_length: int = MIN_LENGTH, exponent: int = EXPONENT,
              edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """The columns of ``docs`` (doc_id, text) but the text, with ``runs`` and ``collapsed_text``.

    ``min_length`` is at least 2 and ``exponent`` at least 2. ``edit`` may replace the words of a document, given its id, before the scan.
    """
    if min_length < 2 or exponent < 2:
        raise ValueError("a run has at least two words and two periods")
    runs_name = fresh(docs, "runs")
    text_name = fresh(docs, "collapsed_text")
    others = [c for c in docs.columns if c != "text"]
    id_at = others.index("doc_id")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lists, held = [], [], 0
            ids = batch.column(id_at).to_pylist()
            for row, text in enumerate(batch.column(batch.num_columns - 1)):
                words = (text.as_py() or b"").split()
                rows.append(row)
                lists.append(edit(ids[row], words) if edit else words)
                held += len(lists[-1])
                if held >= WORDS:
                    yield finished(batch.slice(rows[0], len(rows)), lists)
                    rows, lists, held = [], [], 0
            if rows:
                yield finished(batch.slice(rows[0], len(rows)), lists)

    def finished(batch: pa.RecordBatch, lists: list[list[bytes]]) -> pa.RecordBatch:
        found = runs_of(lists, min_length, exponent)
        flat = [r for runs in found for r in runs]
        parts = [pa.array([r[i] for r in flat], pa.int64()) for i in range(3)]
        fields = [pa.field(c, pa.int64(), False) for c in RUN.names]
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in found])]), pa.int32())
        runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, fields=fields))
        texts = pa.array([b" ".join(collapsed(w, r)) for w, r in zip(lists, found)], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], runs, texts], [*batch.schema.names[:-1], runs_name, text_name])

    schema = StructType([*docs.select(*others).schema.fields, StructField(runs_name, ArrayType(RUN, False)),
                         StructField(text_name, StringType())])
    return docs.select(*others, F.col("text").cast("binary").alias(text_name)).mapInArrow(scan, schema)


def digest_columns(scanned: DataFrame) -> DataFrame:
    """doc_id, the number of runs, the greatest (least start, then least period), and digests of runs and kept words."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return scanned.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-best["start"]).alias("start"), best["length"].alias("length"),
        (-best["period"]).alias("period"), F.floor(1000 * best["length"] / -best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"))
