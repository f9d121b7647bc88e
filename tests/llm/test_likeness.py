"""Near-duplicates, components and fingerprints against plain Python."""

import hashlib
import random
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import fingerprints, near_dedup
from palisade.llm.components import component_labels


def copies(seed=5):
    """Families of near copies around originals; some copies are linked only through others."""
    draw, out = random.Random(seed), []
    words = [f"w{i}" for i in range(3000)]
    for _ in range(12):
        text = draw.choices(words, k=draw.choice((3, 6, 20, 60, 200)))
        for _ in range(draw.choice((1, 1, 4, 9))):
            text = list(text)
            for _ in range(max(0, len(text) // draw.choice((15, 25, 40)))):
                text[draw.randrange(len(text))] = draw.choice(words)
            out.append(" ".join(text))
            if draw.random() < 0.3:
                out.append(" ".join(text).upper().replace(" ", "\t"))
    draw.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_equal_all_pairs(spark, width):
    rows = copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.digest_columns(near_dedup.near_duplicates(df, width)).collect()}
    want = {doc: x for (doc, _), x in zip(rows, brute.components(rows, width))}
    assert got == want and len(set(x[1] for x in got.values())) < len(got)


def test_near_duplicates_of_odd_rows(odd, odd_rows, empty):
    got = near_dedup.digest_columns(near_dedup.near_duplicates(odd, 4)).collect()
    assert len(got) == len(odd_rows)
    no_words = [r for r in got if r.n_shingles == 0]
    assert Counter(r.doc_id for r in no_words) == Counter([None, 3, 4, 5])
    assert all(r.component_id == r.doc_id for r in no_words if r.doc_id is not None)
    assert all(r.kept for r in got if r.doc_id is not None)
    assert near_dedup.near_duplicates(empty, 4).count() == 0
    clash = odd.withColumns({c: F.lit(1) for c in ("row", "id", "digest", "keys", "gone_id", "node")})
    kept = near_dedup.without_near_duplicates(clash)
    assert kept.columns == clash.columns and kept.count() == len(odd_rows)
    assert near_dedup.without_near_duplicates(empty).count() == 0


def test_copies_go_by_row(spark):
    copy, other = "one two three four five six seven", "quite another text under the same number as a copy"
    rows = [(1, copy), (5, copy), (5, other), (None, copy), (None, "only here without a number at all"),
            (None, "said twice without any number at all"), (None, "said twice without any number at all"), (None, None)]
    kept = near_dedup.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([rows[0], rows[2], rows[4], rows[5], rows[7]])


def test_links_hidden_behind_a_hub_are_found(spark):
    """A bucket's hub is linked with none of two members that are linked with each other."""
    base = [f"a{i}" for i in range(100)]
    left = [f"x{i}" if i % 14 == 0 else w for i, w in enumerate(base)]
    right = list(left)
    right[50] = "z"
    rows = [(0, " ".join(base)), (1, " ".join(left)), (2, " ".join(right))]
    want = brute.components(rows, 2)
    got = {r.doc_id: r.component_id for r in near_dedup.digest_columns(
        near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2)).collect()}
    assert [got[i] for i in range(3)] == [w[1] for w in want] and got[2] == 1


def test_sketches_agree_as_often_as_sets():
    hashes, draw, agree, true = near_dedup.WordHashes(), random.Random(1), [], []
    for _ in range(60):
        a = [f"w{draw.randrange(10 ** 6)}" for _ in range(draw.choice((4, 12, 40, 300)))]
        b = a[:-max(1, len(a) // 8)]
        x, y = (near_dedup.shingles(" ".join(t).encode(), 1, hashes) for t in (a, b))
        agree.append(np.mean(near_dedup.sketch(x) == near_dedup.sketch(y)))
        true.append(len(np.intersect1d(x, y)) / len(np.union1d(x, y)))
    assert abs(np.mean(agree) - np.mean(true)) < 0.03


def test_components(spark):
    draw = random.Random(2)
    pairs = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(5, 5)]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in component_labels(spark.createDataFrame(pairs, "u long, v long")).collect()}
    linked = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {x: root(x) for x in linked}
    assert component_labels(spark.createDataFrame([], "u long, v long")).count() == 0


def order_of(row):
    return row[0] is None, row[0] or 0


def test_fingerprints_compare_with_next(spark):
    rows = [(i, f"text number {i} " * (i % 7) + "ending" * (i % 3)) for i in range(0, 90, 3)] + [(200, None), (201, ""), (202, "é€𝄞 ü" * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in fingerprints.compare_with_next(df).collect()}
    assert len(got) == len(rows)
    for (doc, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        text, following = text or "", following or ""
        n = len(text) // 4
        changed = text[:len(text) - n] + following[:n]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert r.fingerprint == one_bit_at_a_time(text) and r.edited_fingerprint == one_bit_at_a_time(changed)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if changed == text:
            assert r.near_edited == 1.0


def one_bit_at_a_time(text):
    """The votes of each term on each bit, in plain form."""
    import math

    import xxhash

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2 ** 64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2 ** 64
        return x ^ (x >> 31)

    h = [xxhash.xxh3_64_intdigest(w.encode()) for w in brute.words(text)]
    single, pair = Counter(mix(x) for x in h), Counter(mix((mix(a) + b) % 2 ** 64) for a, b in zip(h, h[1:]))
    votes = [0.0] * 64
    for terms, weight in ((single, 0.25), (pair, 1.0)):
        for term, n in terms.items():
            for bit in range(64):
                votes[bit] += (1 + math.log(n)) * weight * (1 if term >> bit & 1 else -1)
    return f"{sum(1 << b for b in range(64) if votes[b] > 1e-9):016x}"


def test_fingerprints_of_odd_rows(odd, odd_rows, empty, spark):
    got = fingerprints.compare_with_next(odd.select("doc_id", "text")).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in odd_rows)
    assert len({r.fingerprint for r in got if r.doc_id == 1}) == 1
    assert fingerprints.compare_with_next(empty.select("doc_id", "text")).count() == 0
    one = fingerprints.compare_with_next(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


@pytest.mark.parametrize("radius", [1, 3])
def test_all_near_fingerprints_are_found(spark, radius):
    draw, values = random.Random(3), []
    for _ in range(40):
        v = draw.getrandbits(64)
        values += [v, v] + [v ^ sum(1 << b for b in draw.sample(range(64), k)) for k in (1, 2, 3, 4)]
    df = spark.createDataFrame([(f"{v:016x}",) for v in values], "fingerprint string")
    got = {(r.a, r.b, r.distance) for r in fingerprints.near_fingerprints(df, radius).collect()}
    texts = sorted({f"{v:016x}" for v in values})
    want = {(a, b, d) for i, a in enumerate(texts) for b in texts[i + 1:]
            if (d := (int(a, 16) ^ int(b, 16)).bit_count()) <= radius}
    assert got == want


def test_tiles_compare_all_pairs():
    draw, hashes = random.Random(9), near_dedup.WordHashes()
    texts = [t for _, t in copies(7)] + ["one two three four five"] * 2
    sets = [near_dedup.shingles(t.lower().encode(), 3, hashes) for t in texts]
    got = near_dedup.tile_links(sets, 80)
    want = [least for _, least in brute.components(list(enumerate(texts)), 3)]
    assert got.tolist() == want and draw


def test_stars_over_several_slices(spark, monkeypatch):
    rows = copies(11)
    monkeypatch.setattr(near_dedup, "SLICE", 2)
    monkeypatch.setattr(near_dedup, "_COLUMNS", 16)
    got = {r.doc_id: r.component_id for r in near_dedup.digest_columns(near_dedup.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string"), 4)).collect()}
    assert got == {doc: x[1] for (doc, _), x in zip(rows, brute.components(rows, 4))}


def test_texts_of_a_batch_become_objects_few_at_a_time():
    """A batch has as many rows as the session allows; a task must not hold all its texts and keys twice."""
    import pyarrow as pa

    from palisade.llm import near_dedup as nd

    n = 3 * nd.FEW + 5
    batch = pa.RecordBatch.from_pydict({"row": list(range(n)), "id": list(range(n)),
                                        "text": [None if i % 50 == 0 else f"a b c d word{i}" for i in range(n)]})
    made = list(nd._sketches(4)(iter([batch, batch.slice(0, 0)])))
    assert max(b.num_rows for b in made) <= nd.FEW
    assert [r for b in made for r in b.column(0).to_pylist()] == list(range(n))
    assert [k for b in made for k in b.column(2).to_pylist()] == [0 if i % 50 == 0 else 2 for i in range(n)]
