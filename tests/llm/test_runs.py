"""Periodic runs against a search over all periods."""

import hashlib
import random
import zlib

import pytest

from palisade.llm import queries, runs
from palisade.llm.queries import QUERIES


def by_hand(words, min_length=6, exponent=4):
    """Maximal stretches of every period; one that a smaller period explains is left out."""
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(min_length, exponent * q):
                part = words[i:i + length]
                if not any(all(part[k] == part[k + p] for k in range(length - p)) for p in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def edited(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def digests(doc_id, words):
    found = by_hand(words)
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = [w for i, w in enumerate(words) if i not in gone]
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(kept)).hexdigest())


@pytest.mark.parametrize("exponent,min_length", [(4, 6), (2, 2), (3, 5), (2, 9)])
def test_runs_of_random_words(exponent, min_length):
    rng = random.Random(exponent * 100 + min_length)
    texts = [[rng.choice([b"a", b"b", b"c"][:rng.randrange(1, 4)]) for _ in range(rng.randrange(0, 60))] for _ in range(300)]
    for _ in range(200):  # periods with a few breaks
        unit = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randrange(1, 9))]
        words = (unit * 30)[:rng.randrange(1, 90)]
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(len(words))] = b"x"
        texts.append(words)
    texts += [[], [b"a"] * 400, [b"a", b"b"] * 150, [b"a"] * 5, [b"a"] * 6]
    assert runs.runs_of(texts, min_length, exponent) == [by_hand(t, min_length, exponent) for t in texts]


def test_fibonacci_word_and_nested_runs():
    a, b = [b"a"], [b"b"]
    for _ in range(11):
        a, b = a + b, a
    nested = ([b"x"] * 8 + [b"y"]) * 6
    texts = [a, nested, nested + a + nested]
    assert runs.runs_of(texts, 2, 2) == [by_hand(t, 2, 2) for t in texts]
    assert runs.runs_of(texts) == [by_hand(t) for t in texts]


def test_documents_do_not_share_runs():
    texts = [[b"a"] * 3, [b"a"] * 3, [b"a"] * 7, [b"b", b"a"], [b"a"] * 6]
    assert runs.runs_of(texts) == [[], [], [(0, 7, 1)], [], [(0, 6, 1)]]


def test_query_columns_against_plain_python(spark, tmp_path):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs = [(i, t) for i, t in docs if len((t or "").split()) < 700]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in QUERIES["op13_runs"](spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((digests(i, edited(i, (t or "").encode().split())) for i, t in docs), key=repr)
    assert sum(r[1] > 0 for r in got) > 5


def test_odd_rows(odd, odd_rows):
    found = runs.digest_columns(runs.scan_runs(odd.select("doc_id", "text"))).collect()
    want = [digests(r[0], (r[1] or "").encode().split()) for r in odd_rows if r[0] != 6]
    assert sorted((tuple(r) for r in found if r.doc_id != 6), key=repr) == sorted(want, key=repr)
    long = next(r for r in found if r.doc_id == 6)
    assert (long.start, long.length, long.period) == (0, 60000, 3) and long.n_runs == 2


def test_empty_table_and_clashing_columns(spark, empty):
    assert runs.scan_runs(empty).count() == 0
    docs = spark.createDataFrame([(1, 2, "a " * 9, 3)], "runs int, doc_id long, text string, collapsed_text int")
    row = runs.scan_runs(docs).collect()[0].asDict(recursive=True)
    assert row == {"runs": 1, "doc_id": 2, "collapsed_text": 3, "_runs": [{"start": 0, "length": 9, "period": 1}], "_collapsed_text": "a"}


def test_slices_do_not_show(spark, small, monkeypatch):
    df = spark.createDataFrame([(d["doc_id"], (d["text"] or "") + " x y" * 9) for d in small], "doc_id long, text string")
    want = sorted(map(repr, runs.scan_runs(df).collect()))
    assert all("start=" in w for w in want)
    lists = [((d["text"] or "") + " x y" * 9).encode().split() for d in small]
    assert [r for part in lists for r in runs.runs_of([part])] == runs.runs_of(lists)


def test_the_edit_of_the_query():
    for doc in range(300):
        words = [f"w{i}" for i in range(doc)]
        assert queries.periodic_edit(doc, words) == edited(doc, words)
    assert queries.periodic_edit(None, ["a"]) == ["a"]
