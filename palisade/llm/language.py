"""Language identification: known words first, backing off to ever shorter character n-grams.

A known word scores the log of its frequency in each language. An unknown word is cut into n-grams (with ``<``
and ``>`` at its ends) of the greatest length of which any is known, and scores the mean of their log
frequencies. A text's language is the one with the highest sum; its score is that language's share of the
posterior.

The model is fitted on at most ``sample`` labelled rows and ``sample_bytes`` bytes of text for each language, the rows
with the least hashes of id and text, whole. Words and n-grams are counted by Spark; of their counts a language keeps
the most frequent ``max_words`` words and as many n-grams, and all languages together ``MAX_ENTRIES`` of each. The
counts leave Spark as Arrow columns and stay sparse: a name lists the languages that have it, all others share a floor.
So the model has a bounded size for any number of languages and is sent to all tasks. Prediction reads every text whole.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; documents without language or id
teach nothing; without any labelled document every text is ``und`` and ``with_language`` keeps all texts with a letter;
equal sums go to the first language in code-point order; rows that repeat id and text count once each, within the same
bounds; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import fresh, stored, unit_draw

UNKNOWN = "und"
SAMPLE, SAMPLE_BYTES = 1000, 64 << 20
MAX_WORDS, MAX_ENTRIES = 60_000, 600_000
LONGEST_GRAM = 4
#: Scores that a task keeps at hand, over all words and languages; words that are looked up and rows that are read together.
CACHE, BLOCK, ROWS = 1_000_000, 50_000, 500
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def has_letter(words: list[str]) -> bool:
    return any(c.isalpha() for w in words for c in w)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


@dataclass
class Shares:
    """Sparse log shares: ``names``, for each from ``start`` on the languages that have it and by how much it lies above ``floor``."""

    names: pa.Array
    start: np.ndarray
    lang: np.ndarray
    gain: np.ndarray
    floor: np.ndarray

    def index(self) -> dict[str, int]:
        return {name: i for i, name in enumerate(self.names.to_pylist())}

    def scores(self, at: list[int], owner: list[int] | np.ndarray | None = None, size: int | None = None) -> np.ndarray:
        """The scores of the names ``at``, one row each, or the mean for each of ``size`` owners."""
        at, n = np.asarray(at, np.int64), len(self.floor)
        owner, size = (np.arange(len(at)), len(at)) if owner is None else (np.asarray(owner, np.int64), size)
        first, many = self.start[at], self.start[at + 1] - self.start[at]
        place = np.repeat(first - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        above = np.bincount(np.repeat(owner, many) * n + self.lang[place], self.gain[place], size * n).reshape(size, n)
        return self.floor + above / np.maximum(np.bincount(owner, minlength=size), 1)[:, None]


@dataclass
class LanguageModel:
    """Shares of the words (place 0) and of the n-grams of each length n."""

    languages: list[str]
    shares: list[Shares]


class Scorer(dict):
    """Row of each word in a table of scores; words are added when first met, many at a time."""

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model = model
        self.known = [s.index() for s in model.shares]
        self.most = CACHE // max(1, len(model.languages))
        self.scores = np.empty((1024, len(model.languages)), np.float32)
        # single characters that only frame words
        self.frame = {self.known[1][c] for c in "<>" if c in self.known[1]}

    def backoff(self, words: list[str]) -> np.ndarray:
        """The scores of unknown words: the means over their n-grams of the greatest length that has any."""
        out = np.zeros((len(words), len(self.model.languages)))
        left = [f"<{word}>" for word in words]
        open_ = list(range(len(words)))
        for n in range(LONGEST_GRAM, 0, -1):
            known, at, owner, done = self.known[n], [], [], []
            for i in open_:
                framed = left[i]
                found = [k for k in map(known.get, [framed[j:j + n] for j in range(len(framed) - n + 1)]) if k is not None]
                if n == 1:
                    found = [k for k in found if k not in self.frame]
                if found:
                    owner += [len(done)] * len(found)
                    at += found
                    done.append(i)
            if done:
                out[done] = self.model.shares[n].scores(at, owner, len(done))
                open_ = sorted(set(open_).difference(done))
        return out

    def learn(self, words: set[str]) -> None:
        if len(self) + len(words) > self.most:
            self.clear()
        new = [w for w in words if w not in self]
        used = len(self)
        if used + len(new) > len(self.scores):
            grown = np.empty((max(2 * len(self.scores), used + len(new)), self.scores.shape[1]), np.float32)
            grown[:used] = self.scores[:used]
            self.scores = grown
        at = [self.known[0].get(w) for w in new]
        have = [i for i, k in enumerate(at) if k is not None]
        lack = [i for i, k in enumerate(at) if k is None]
        rows = np.empty((len(new), self.scores.shape[1]))
        rows[have] = self.model.shares[0].scores([at[i] for i in have])
        rows[lack] = self.backoff([new[i] for i in lack])
        self.scores[used:used + len(new)] = rows
        self.update(zip(new, range(used, used + len(new))))

    def __missing__(self, word: str) -> int:
        self.learn({word})
        return self[word]

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        total, lettered = np.zeros((len(texts), len(self.model.languages))), []
        held, owner, size = [], [], 0
        for i, text in enumerate(texts):
            words = words_of(text) if text else []
            lettered.append(has_letter(words))
            for first in range(0, len(words) if self.model.languages else 0, BLOCK):
                held.append(words[first:first + BLOCK])
                owner.append(i)
                size += len(held[-1])
                if size >= BLOCK:
                    self._add(total, held, owner)
                    held, owner, size = [], [], 0
        if held:
            self._add(total, held, owner)
        if not self.model.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        best = total.argmax(axis=1)
        share = 1.0 / np.exp(np.minimum(total - total.max(axis=1, keepdims=True), 0)).sum(axis=1)
        return [(self.model.languages[b], float(s)) if found else (UNKNOWN, 0.0) for b, s, found in zip(best, share, lettered)]

    def _add(self, total: np.ndarray, held: list[list[str]], owner: list[int]) -> None:
        """Add the scores of the words of each part to the total of its text."""
        self.learn(set().union(*held))
        sizes = np.array([len(h) for h in held])
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(held)), np.int64, int(sizes.sum()))
        np.add.at(total, owner, np.add.reduceat(self.scores[at], np.cumsum(sizes) - sizes, axis=0, dtype=np.float64))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: Counter = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            for word, n in Counter(words_of(text)).items():
                found[lang, word] += n
        keys = list(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
             pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])


def grams_of(word: str) -> list[str]:
    framed = f"<{word}>"
    return [framed[i:i + n] for n in range(1, LONGEST_GRAM + 1) for i in range(len(framed) - n + 1)]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: Counter = Counter()
        for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n"))):
            for gram in grams_of(word):
                found[lang, gram] += n
        keys = list(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
             pa.array(list(found.values()), pa.int64())], ["lang", "gram", "n"])


def drawn(docs: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """lang, text of the rows to learn from: for each language those with the least hashes of id and text, within both bounds.

    Rows that are held out, or lack a language, text or id, teach nothing.
    """
    labelled = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = stored(labelled.groupBy("lang").count().select(
        F.col("lang").alias("size_lang"), F.col("count").alias("n_docs")), "language-sizes")
    draw = unit_draw(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.md5(F.col("text").cast("binary"))), "language")
    # most rows go before any is ranked
    near = (labelled.join(sizes, F.col("lang") == F.col("size_lang")).withColumn("draw", draw)
            .where(F.col("draw") * F.col("n_docs") < 4 * sample))
    order = Window.partitionBy("lang").orderBy("draw", "doc_id")
    first = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample)
    size = F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("place"))
    return first.withColumn("bytes", size).where((F.col("bytes") <= sample_bytes) | (F.col("place") == 1)).select("lang", "text")


def _most_frequent(counts: DataFrame, name: str, each: int) -> pa.Table:
    """lang, name, n of the ``each`` most frequent names of every language, as Arrow columns."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), name)
    return (counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= each)
            .select("lang", F.col(name).alias("name"), "n").toArrow())


def fit(docs: DataFrame, sample: int = SAMPLE, max_words: int = MAX_WORDS, sample_bytes: int = SAMPLE_BYTES) -> LanguageModel:
    """Learn from ``docs`` (doc_id, text, lang)."""
    counts = (drawn(docs, sample, sample_bytes).mapInArrow(_count_words, "lang string, word string, n long")
              .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    counts = stored(counts, "language-words")
    grams = stored(counts.mapInArrow(_count_grams, "lang string, gram string, n long")
                   .groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-grams")
    languages = max(1, counts.select("lang").distinct().count())
    words = _most_frequent(counts, "word", min(max_words, max(1, MAX_ENTRIES // languages)))
    return build(words, _most_frequent(grams, "gram", max(1, MAX_ENTRIES // languages)))


def build(words: pa.Table, grams: pa.Table) -> LanguageModel:
    """The model of Arrow columns (lang, name, n): counts of words and of n-grams."""
    languages = sorted(set(words.column("lang").to_pylist()))
    length = pc.utf8_length(grams.column("name"))
    return LanguageModel(languages, [_shares(words, languages)] + [
        _shares(grams.filter(pc.equal(length, n)), languages) for n in range(1, LONGEST_GRAM + 1)])


def _shares(table: pa.Table, languages: list[str]) -> Shares:
    lang = pc.index_in(table.column("lang"), pa.array(languages, pa.string())).to_numpy().astype(np.int64)
    n = table.column("n").to_numpy().astype(np.float64)
    coded = table.column("name").combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    name = coded.indices.to_numpy().astype(np.int64)
    order = np.lexsort((lang, name))
    start = np.searchsorted(name[order], np.arange(len(coded.dictionary) + 1))
    # half a count for every name that a language lacks
    floor = np.log(0.5) - np.log(np.bincount(lang, n, len(languages)) + 0.5 * max(1, len(coded.dictionary)))
    return Shares(coded.dictionary, start.astype(np.int32), lang[order].astype(np.uint16),
                  np.log(2 * n[order] + 1).astype(np.float32), floor)


def _texts(batch: pa.RecordBatch, column: int = -1) -> Iterator[list[str | None]]:
    """A column, ``ROWS`` texts at a time."""
    for first in range(0, batch.num_rows, ROWS):
        yield batch.column(column % batch.num_columns).slice(first, ROWS).to_pylist()


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [f for texts in _texts(batch) for f in scorer.predict_all(texts)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                [*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score for each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _predict(shared), "doc_id long, lang_pred string, score double")


def with_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` without the texts that have no letter; a missing ``lang`` is filled with the prediction.

    When nothing was learned ``lang`` stays as it is.
    """
    name, text = fresh(docs, "lang_pred"), [c.lower() for c in docs.columns].index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    learned = bool(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found: list[str | None] = []
            for texts in _texts(batch, text):
                if learned:
                    found += [f[0] for f in scorer.predict_all(texts)]
                else:
                    found += [None if t and has_letter(words_of(t)) else UNKNOWN for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, name])

    schema = StructType([*docs.schema.fields, StructField(name, StringType())])
    predicted = docs.mapInArrow(run, schema).where(F.col(name).isNull() | (F.col(name) != UNKNOWN))
    return predicted.withColumn("lang", F.coalesce("lang", name)).select(*docs.columns)
