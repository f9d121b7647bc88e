"""The hidden Markov language model against sums over paths and against textbook recursions."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from palisade.llm import hmm
from palisade.llm.queries import QUERIES

COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"]


def tokens_of(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + [None]


def base_rows(docs):
    """All columns but the model's score, by plain Python."""
    out = [doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2 for doc, _ in docs]
    c = Counter(t for (_, text), held in zip(docs, out) if not held for t in tokens_of(text))
    n, v = sum(c.values()), len(c)
    return sorted(((doc, held, len(tokens_of(text)), sum(c[t] > 0 for t in tokens_of(text)), n,
                    round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens_of(text)), 6))
                   for (doc, text), held in zip(docs, out)), key=repr)


def rows(df):
    return sorted(((*tuple(r)[:5], round(r.base_score, 6)) for r in df.select(*COLUMNS).collect()), key=repr)


def random_model(rng, classes, states):
    def shares(*shape):
        x = rng.random(shape) + 0.05
        return x / x.sum(axis=-1, keepdims=True)

    return hmm.Model(shares(states), shares(states, states), shares(states, classes).T.copy())


def over_paths(codes, m):
    """Likelihood as the sum over all state paths."""
    states = range(len(m.start))
    return sum(m.start[p[0]] * math.prod(m.step[a, b] for a, b in itertools.pairwise(p))
               * math.prod(m.emit[c, s] for c, s in zip(codes, p)) for p in itertools.product(states, repeat=len(codes)))


def textbook(codes, m):
    """Expected counts by unscaled recursions, one text at a time."""
    n, states = len(codes), len(m.start)
    alpha, beta = np.zeros((n, states)), np.ones((n, states))
    alpha[0] = m.start * m.emit[codes[0]]
    for t in range(1, n):
        alpha[t] = alpha[t - 1] @ m.step * m.emit[codes[t]]
    for t in range(n - 2, -1, -1):
        beta[t] = m.step @ (m.emit[codes[t + 1]] * beta[t + 1])
    total = alpha[-1].sum()
    gamma = alpha * beta / total
    emitted = np.zeros_like(m.emit)
    for t, c in enumerate(codes):
        emitted[c] += gamma[t]
    moved = sum((np.outer(alpha[t], m.emit[codes[t + 1]] * beta[t + 1]) * m.step / total for t in range(n - 1)),
                np.zeros((states, states)))
    return total, emitted, moved, gamma[0]


@pytest.mark.parametrize("piece", [1, 2, 3, 100])
def test_likelihood_is_the_sum_over_paths(piece):
    rng = np.random.default_rng(piece)
    m = random_model(rng, 5, 3)
    texts = [rng.integers(0, 5, n) for n in (1, 2, 3, 4, 5, 6, 7, 7, 1)]
    got = hmm.Pieces(texts, m, piece).likelihood()
    assert np.allclose(np.exp(got), [over_paths(t, m) for t in texts], rtol=1e-12)


@pytest.mark.parametrize("piece", [1, 2, 7, 100])
def test_expected_counts_are_the_textbook_ones(piece, monkeypatch):
    rng = np.random.default_rng(piece + 10)
    m = random_model(rng, 6, 4)
    texts = [rng.integers(0, 6, n) for n in (1, 3, 8, 15, 40, 2, 21, 7)]
    want = [textbook(t, m) for t in texts]
    for tokens in (10**6, 9):  # all pieces together, few at a time
        monkeypatch.setattr(hmm, "TOKENS", tokens)
        pieces = hmm.Pieces(texts, m, piece)
        got = pieces.expected()
        assert np.allclose(pieces.likelihood(), [math.log(w[0]) for w in want])
        for i in range(3):
            assert np.allclose(got[i], sum(w[i + 1] for w in want), rtol=1e-9)


def test_long_text_does_not_underflow():
    rng = np.random.default_rng(3)
    m = random_model(rng, 50, 8)
    text = rng.integers(0, 50, 30000)
    whole = hmm.Pieces([text], m, 10**6).likelihood()
    assert np.allclose(hmm.Pieces([text, text[:5]], m, 512).likelihood()[:1], whole, rtol=1e-11)


def test_rounds_raise_the_training_likelihood(spark, small):
    docs = spark.createDataFrame([(d["doc_id"], d["text"]) for d in small], "doc_id long, text string").repartition(3)
    tokens = hmm.tokenised(docs, 500)
    counts = hmm.count_words(tokens, 500)
    train = [np.frombuffer(r.codes, np.uint16) for r in tokens.where("not held_out").collect()]
    found = [hmm.Pieces(train, hmm.train(tokens, counts, 4, rounds)).likelihood().sum() for rounds in (0, 1, 3)]
    assert found[0] < found[1] < found[2]
    again = hmm.train(tokens.repartition(5), counts, 4, 2)
    assert np.allclose(again.emit, hmm.train(tokens, counts, 4, 2).emit, rtol=1e-3)


def test_trained_model_equals_one_text_at_a_time(spark, small):
    docs = spark.createDataFrame([(d["doc_id"], (d["text"] or "")[:300]) for d in small], "doc_id long, text string").repartition(2)
    tokens = hmm.tokenised(docs, 200)
    counts = hmm.count_words(tokens, 200)
    model = hmm.first_model(counts.sizes, 3)
    for _ in range(2):
        found = [textbook(np.frombuffer(r.codes, np.uint16), model) for r in tokens.where("not held_out").collect()]
        model = hmm.next_model(counts.sizes, *(sum(f[i] for f in found) for i in (1, 2, 3)))
    got = hmm.train(tokens, counts, 3, 2)
    assert np.allclose(got.step, model.step, atol=1e-4) and np.allclose(got.emit, model.emit, atol=1e-4)


def test_scores_are_probabilities(spark):
    """Over all texts of one token and an end, known or not, the probabilities of the model leave nothing over."""
    docs = [(i, "a b c a b a") for i in range(20)]
    tokens = hmm.tokenised(spark.createDataFrame(docs, "doc_id long, text string"), 7)
    counts = hmm.count_words(tokens, 7)
    assert counts.tokens == 7 * sum(zlib.crc32(str(i).encode()) % 7 != 2 for i in range(20)) and counts.distinct == 4
    model = hmm.train(tokens, counts, 2, 2)
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.step.sum(axis=1), 1)
    for word, c in (("a", 3), ("b", 2), ("c", 1), ("unseen", 0)):
        of = zlib.crc32(word.encode()) % 7
        train = sum(zlib.crc32(str(i).encode()) % 7 != 2 for i in range(20))
        scored = hmm.score(spark.createDataFrame(docs + [(2, word)], "doc_id long, text string"), 2, 7, 2)
        got = scored.where("n_tokens = 2").first()
        m = hmm.Pieces([np.array([of, 7])], model).likelihood()[0] if zlib.crc32(b"2") % 7 == 2 else None
        if m is not None:
            assert math.isclose(got.score, (m + math.log((c * train + (c > 0)) / (counts.sizes[of] + 1) if c else 1 / (counts.sizes[of] + 1))) / math.log(10), rel_tol=1e-9)


def test_base_columns_equal_plain_python(spark, small):
    docs = [(d["doc_id"], d["text"]) for d in small]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows(hmm.score(df, 2, 50, 1)) == base_rows(docs)


def test_odd_rows_and_empty_tables(spark, odd, odd_rows, empty):
    assert rows(hmm.score(odd, 2, 50, 1)) == base_rows([(r[0], r[1]) for r in odd_rows])
    assert hmm.score(empty, 2, 50, 1).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    none = spark.createDataFrame([(held, "a b"), (held, None)], "doc_id long, text string")
    assert rows(hmm.score(none, 2, 50, 1)) == base_rows([(held, "a b"), (held, None)])


def test_no_word_fills_a_join(spark, monkeypatch):
    """Frequent words take another way to the same result."""
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["the", "the", f"w{rng.randrange(300)}"]) for _ in range(50))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = base_rows(docs)
    for part in (1, 20, 10**9):
        monkeypatch.setattr(hmm, "FREQUENT", part)
        assert rows(hmm.score(df, 2, 50, 1)) == want


def test_query_beats_single_words_on_held_out_texts(spark):
    found = QUERIES["op12_language_model"](spark, "/root/testdata/sf0.001").where("held_out").collect()
    assert found and sum(r.score for r in found) > sum(r.base_score for r in found)
