"""Importance resampling against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import words

from palisade.llm import resampling


def features(text):
    w = words(text)
    return [" ".join(w[i:i + n]) for n in (1, 2) for i in range(len(w) - n + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def by_hand(docs, target, percent=25, min_words=20):
    s = Counter(bucket(f) for _, t in docs for f in features(t))
    t = Counter(bucket(f) for text in target for f in features(text))
    total_s, total_t = sum(s.values()), sum(t.values())
    out = []
    for doc, text in docs:
        found = features(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000) / ((s[b] + 1) * (total_t + 10000))))
                for b in map(bucket, found)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    enough = sorted((r for r, d in zip(out, docs) if len(words(d[1])) >= min_words),
                    key=lambda r: (-r[3], float("inf") if r[0] is None else r[0]))
    for place, r in enumerate(enough[:len(enough) * percent // 100]):
        r[4] = place + 1
    return sorted(map(tuple, out), key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([("i1", "the words of an item, the word of"), ("i2", None), ("i3", "")], "item_id string, text string")


def test_ranks_equal_plain_python(spark, small, target):
    docs = [(d["doc_id"], d["text"]) for d in small]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows(resampling.ranked(df, target)) == by_hand(docs, [r.text for r in target.collect()])


def test_odd_rows(odd, odd_rows, target):
    docs = [(r[0], r[1]) for r in odd_rows]
    assert rows(resampling.ranked(odd, target, percent=60)) == by_hand(docs, [r.text for r in target.collect()], percent=60)


def test_empty_tables(spark, odd, odd_rows, empty, target):
    assert rows(resampling.ranked(empty, target)) == []
    nothing = target.where("false")
    assert rows(resampling.ranked(odd, nothing)) == by_hand([(r[0], r[1]) for r in odd_rows], [])


def test_a_third_under_one_id_and_text(spark, target):
    docs = [(None, "the same text " * 10)] * 40 + [(i, f"text number {i} " * 10) for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert rows(resampling.ranked(df, target)) == by_hand(docs, [r.text for r in target.collect()])


def test_blocks_and_slices_do_not_show(small, monkeypatch):
    texts = [(d["text"] or "").encode() for d in small]

    def counted():
        found = Counter()
        for first, part in resampling._sliced(texts):
            for n, doc, b in resampling.feature_buckets(part, resampling.WordSums(), longest=3):
                found.update(zip([n] * len(doc), (doc + first).tolist(), b.tolist()))
        return found

    whole = counted()
    monkeypatch.setattr(resampling, "BLOCK", 5)
    monkeypatch.setattr(resampling, "SLICE", 3000)
    monkeypatch.setattr(resampling, "CACHE", 50)
    assert counted() == whole
    want = Counter()
    for i, t in enumerate(texts):
        w = words(t.decode())
        want.update((n, i, bucket(" ".join(w[j:j + n]))) for n in (1, 2, 3) for j in range(len(w) - n + 1))
    assert whole == want


def test_crc_of_joined_texts():
    rng = random.Random(5)
    a = [rng.randbytes(rng.randrange(0, 40)) for _ in range(200)]
    b = [rng.randbytes(rng.choice([0, 1, 7, 300, 70000])) for _ in a]
    got = resampling.appended(np.array([zlib.crc32(x) for x in a], np.uint32), np.array([zlib.crc32(x) for x in b], np.uint32),
                              np.array([len(x) for x in b], np.int64))
    assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b)]


def test_drawn_rows_keep_their_columns(spark, target):
    docs = spark.createDataFrame([(i % 30, f"some words of document {i} " * 6, 1, 2, 3) for i in range(60)],
                                 "doc_id long, text string, rank long, weight long, row_number long").repartition(2)
    drawn = resampling.resample(docs, target)
    assert drawn.columns == docs.columns and drawn.count() == 15
    best = resampling.ranked(docs.select("doc_id", "text"), target).where("rank is not null")
    assert sorted(r.doc_id for r in drawn.collect()) == sorted(r.doc_id for r in best.collect())


def test_draw_leans_towards_the_target(spark):
    """Documents made of the target's words are drawn far more often than others."""
    docs = spark.createDataFrame([(i, ("red green blue " if i % 4 == 0 else "one two three ") * 20) for i in range(400)],
                                 "doc_id long, text string")
    drawn = resampling.resample(docs, spark.createDataFrame([("i", "red green blue " * 200)], "item_id string, text string")).collect()
    assert len(drawn) == 100 and sum(r.doc_id % 4 == 0 for r in drawn) > 90
