"""A hidden Markov language model over whole texts.

Tokens are lower-cased words and one end per text. Latent states emit word classes, a class being the CRC-32 of a
word modulo ``n_classes`` (the end has a class of its own), and a class emits its words by their counts in the
training texts, with one count more for each and one for all words not seen:

    P(text) = sum over state paths of P(path) x P(classes | path)  x  product over words of (c + 1) / (class size + 1)

So every word of the corpus counts, however many there are, while what the states know has a fixed size that tasks
can hold. Word counts are a table; they meet the words of the texts in a join. A word with more than
1 / ``FREQUENT`` of all tokens is one of at most ``FREQUENT`` such words; these are sent to all tasks, and no other word
can fill a join partition.

Baum-Welch: each round, tasks run the scaled forward and backward recursions over the training texts and add up the
expected emissions, transitions and starts; Spark sums them across tasks in whole 2**-16ths, so the order does not matter,
and the driver derives the next parameters from (n_classes + 1) x states sums. The scaled forward recursion then gives the
exact likelihood of every text. Texts are stepped through side by side; one longer than ``PIECE`` tokens is cut into
pieces whose transfer matrices carry the exact forward and backward vectors from piece to piece, so that a long text
takes no longer in a task than its tokens warrant.

Defined cases: a null or empty text is its end alone; a null id is not held out; rows that repeat an id are each
scored; without training texts all words are unknown and classes and states alike; an empty table gives no rows;
other columns do not matter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

STATES, N_CLASSES, ROUNDS = 8, 32_768, 4
#: A part in so many of all tokens makes a word frequent.
FREQUENT = 1 << 20
#: Bytes of text cut into words together, tokens stepped through together, tokens of a piece, and steps between scalings.
SLICE, TOKENS, PIECE, RESCALE = 1 << 22, 2_000_000, 8192, 8
#: Words whose classes a task keeps at hand.
CACHE = 500_000
UNIT = 65536.0


def held_out(doc_id: Column, parts: int = 7, part: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


class Classes(dict):
    """Class of each word, filled when a word is first met."""

    def __init__(self, n_classes: int):
        super().__init__()
        self.n_classes = n_classes

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = zlib.crc32(word) % self.n_classes
        return value


def tokenised(docs: DataFrame, n_classes: int = N_CLASSES) -> DataFrame:
    """row, doc_id, held_out, codes (the classes of all tokens as 16-bit numbers), and the different words with their numbers."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(n_classes)
        for batch in batches:
            first, held, codes, words, counts = 0, 0, [], [], []
            for i, text in enumerate(batch.column(3)):
                raw = text.as_py() or b""
                found = raw.lower().split()
                codes.append(np.fromiter((*map(classes.__getitem__, found), n_classes), np.uint16, len(found) + 1).tobytes())
                words.append(Counter(found))
                held += len(raw)
                if held >= SLICE:
                    yield packed(batch.slice(first, i + 1 - first), codes, words)
                    first, held, codes, words = i + 1, 0, [], []
            if codes:
                yield packed(batch.slice(first), codes, words)

    def packed(batch: pa.RecordBatch, codes: list[bytes], words: list[Counter]) -> pa.RecordBatch:
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(w) for w in words])]), pa.int32())
        flat = pa.array([w for found in words for w in found], pa.binary()).cast(pa.string())
        n = pa.array([n for found in words for n in found.values()], pa.int32())
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(codes, pa.binary()), pa.ListArray.from_arrays(offsets, flat), pa.ListArray.from_arrays(offsets, n)],
            ["row", "doc_id", "held_out", "codes", "words", "ns"])

    if n_classes >= 1 << 16:
        raise ValueError("classes are kept as 16-bit numbers")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("text"))
    return stored(rows.mapInArrow(cut, "row long, doc_id long, held_out boolean, codes binary, words array<string>, ns array<int>"),
                  "hmm-tokens", "zstd")


def _words(tokens: DataFrame) -> DataFrame:
    pairs = F.explode(F.arrays_zip("words", "ns"))
    return tokens.select("row", pairs.alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.ns").cast("long").alias("n"))


@dataclass
class Counts:
    """Training counts: words (word, c) as a table, totals, and the sizes of the classes."""

    words: DataFrame
    tokens: int
    distinct: int
    sizes: np.ndarray  # of each class, the end last: the counts of its words, plus one each


def count_words(tokens: DataFrame, n_classes: int = N_CLASSES) -> Counts:
    train = tokens.where(~F.col("held_out"))
    words = stored(_words(train).groupBy("word").agg(F.sum("n").alias("c")), "hmm-words")
    of = F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(n_classes)).cast("int")
    classes = words.groupBy(of.alias("class")).agg(F.sum(F.col("c") + 1).alias("size"), F.count("*").alias("n"))
    sizes, distinct = np.zeros(n_classes + 1), 0
    for row in classes.collect():  # at most n_classes rows
        sizes[row["class"]], distinct = row["size"], distinct + row["n"]
    texts = train.count()
    sizes[n_classes] = texts + (texts > 0)
    ends = int(texts > 0)
    return Counts(words, int(sizes.sum()) - distinct - ends, distinct + ends, sizes)


@dataclass
class Model:
    start: np.ndarray  # states
    step: np.ndarray  # state x next state
    emit: np.ndarray  # class x state: the share of the class in the state


def first_model(sizes: np.ndarray, states: int = STATES, seed: int = 12) -> Model:
    """Class shares with a little noise that tells the states apart; states tend to stay."""
    share = (sizes + 1.0) / (sizes + 1.0).sum()
    emit = share[:, None] * (0.5 + np.random.RandomState(seed).random_sample((len(sizes), states)))
    step = np.full((states, states), 0.1 / states) + np.eye(states) * 0.9
    return Model(np.full(states, 1.0 / states), step, emit / emit.sum(axis=0))


def next_model(sizes: np.ndarray, emitted: np.ndarray, moved: np.ndarray, started: np.ndarray) -> Model:
    """Parameters from expected counts; the overall shares weigh as many tokens as a state has different classes."""
    share = (sizes + 1.0) / (sizes + 1.0).sum()
    emit = emitted + np.maximum(1.0, np.minimum(emitted, 1.0).sum(axis=0)) * share[:, None]
    moved, started = moved + 1.0, started + 1.0
    return Model(started / started.sum(), moved / moved.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


class Pieces:
    """Texts given by their codes, cut into pieces that are stepped through side by side, longest first.

    ``kind`` is the precision of the recursions within a piece: single will do for expected counts.
    """

    def __init__(self, codes: list[np.ndarray], model: Model, piece: int | None = None, kind: type = np.float64):
        piece = piece or PIECE
        self.model, self.n_texts, self.kind = model, len(codes), kind
        self.codes = np.concatenate(codes).astype(np.int64)
        sizes = np.array([len(c) for c in codes], np.int64)
        many = -(-sizes // piece)
        text = np.repeat(np.arange(len(codes)), many)
        place = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        length = np.minimum(piece, sizes[text] - place * piece)
        begin = (np.cumsum(sizes) - sizes)[text] + place * piece
        order = np.argsort(-length, kind="stable")
        self.text, self.place, self.length, self.begin = text[order], place[order], length[order], begin[order]
        self.first = self.place == 0
        self.last = self.place == many[self.text] - 1
        states = len(model.start)
        self.coming = np.repeat(model.start[None], len(text), axis=0)
        self.going = np.ones((len(text), states))
        if many.max(initial=0) > 1:
            self._join(np.flatnonzero(many[self.text] > 1))

    def _emitted(self, step: int, chosen: np.ndarray) -> np.ndarray:
        return self.model.emit[self.codes[self.begin[chosen] + step]]

    def _join(self, chosen: np.ndarray) -> None:
        """The vectors that come to and go from the pieces ``chosen``, of texts in several pieces."""
        step, states = self.model.step, len(self.model.start)
        through = np.where(self.first[chosen][:, None, None], np.eye(states), step) * self._emitted(0, chosen)[:, None]
        for t in range(1, int(self.length[chosen[0]])):
            n = np.searchsorted(-self.length[chosen], -t)  # those longer than t
            moved = (through[:n].reshape(-1, states) @ step).reshape(n, states, states) * self._emitted(t, chosen[:n])[:, None]
            through[:n] = moved / moved.max(axis=(1, 2), keepdims=True)
        by_place = np.lexsort((self.place[chosen], self.text[chosen]))
        at = {}
        for k in by_place:
            at.setdefault(int(self.place[chosen[k]]), []).append(k)
        order = [np.array(at[p]) for p in range(len(at))]  # pieces with place p, by text
        for p in range(1, len(order)):
            here = order[p]
            before = order[p - 1][np.isin(self.text[chosen[order[p - 1]]], self.text[chosen[here]])]
            vector = np.einsum("ni,nij->nj", self.coming[chosen[before]], through[before])
            self.coming[chosen[here]] = vector / vector.sum(axis=1, keepdims=True)
        for p in range(len(order) - 1, 0, -1):
            here = order[p]
            before = order[p - 1][np.isin(self.text[chosen[order[p - 1]]], self.text[chosen[here]])]
            vector = np.einsum("nij,nj->ni", through[here], self.going[chosen[here]])
            self.going[chosen[before]] = vector / vector.sum(axis=1, keepdims=True)

    def likelihood(self) -> np.ndarray:
        """Natural log likelihood of each text."""
        found = [Steps(self, part).forward() for part in self._parts()]
        return np.bincount(self.text, np.concatenate(found), self.n_texts)

    def expected(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected emissions (class x state), transitions (state x state) and starts (state)."""
        states = len(self.model.start)
        emitted, moved, started = np.zeros(self.model.emit.shape), np.zeros((states, states)), np.zeros(states)
        for part in self._parts():
            Steps(self, part).expect(emitted, moved, started)
        return emitted, moved * self.model.step, started

    def _parts(self) -> Iterator[slice]:
        """Pieces of about ``TOKENS`` tokens at a time."""
        ends, begin = np.cumsum(self.length), 0
        while begin < len(ends):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + TOKENS, side="right")))
            yield slice(begin, end)
            begin = end


class Steps:
    """The recursions over some pieces: states by tokens, the tokens of a step side by side.

    Vectors are brought back to sum 1 every ``RESCALE`` steps. The likeliest state of a class emits it with share 1 here,
    so that vectors shrink slowly between scalings; the true shares enter the likelihood as logarithms.
    """

    def __init__(self, pieces: Pieces, part: slice):
        length, begin, kind = pieces.length[part], pieces.begin[part], pieces.kind
        self.step, self.first = pieces.model.step.astype(kind), pieces.first[part]
        self.coming, self.going = pieces.coming[part].T.astype(kind), pieces.going[part].T.astype(kind)
        # pieces with a token at each step, and where the tokens of the step begin
        self.active = np.searchsorted(-length, -np.arange(1, int(length.max()) + 1), side="right").tolist()
        self.at = (np.cumsum(self.active) - self.active).tolist()
        step = np.repeat(np.arange(len(self.active)), self.active)
        self.piece = np.arange(len(step)) - np.repeat(self.at, self.active)
        self.codes = pieces.codes[begin[self.piece] + step]
        # shares in proportion to the greatest of their class
        self.top = pieces.model.emit.max(axis=1)
        self.emitted = (pieces.model.emit / self.top[:, None]).T.astype(kind)[:, self.codes]
        self.ahead = np.empty_like(self.emitted)
        self.scale = np.ones(len(step), kind)

    def forward(self) -> np.ndarray:
        """Log likelihood of each piece; leaves the scaled forward vectors in ``ahead``."""
        turn = np.ascontiguousarray(self.step.T)
        total = np.bincount(self.piece, np.log(self.top)[self.codes], len(self.first))
        ends = [*self.active[1:], 0]
        for t, (at, n, end) in enumerate(zip(self.at, self.active, ends)):
            now = self.ahead[:, at:at + n]
            if t:
                before = self.at[t - 1]
                np.matmul(turn, self.ahead[:, before:before + n], out=now)
            else:
                np.copyto(now, np.where(self.first, self.coming, turn @ self.coming))
            now *= self.emitted[:, at:at + n]
            if t % RESCALE == RESCALE - 1:
                scale = now.sum(axis=0)
                now /= scale
                self.scale[at:at + n] = scale
                total[:n] += np.log(scale)
            if end < n:
                total[end:n] += np.log(now[:, end:].sum(axis=0))
        return total

    def expect(self, all_emitted: np.ndarray, moved: np.ndarray, started: np.ndarray) -> None:
        """Adds the expectations; ``moved`` still lacks the transition itself."""
        self.forward()
        step, behind = self.step, np.empty_like(self.emitted)
        after = 0
        for t in range(len(self.active) - 1, -1, -1):
            at, n = self.at[t], self.active[t]
            now = behind[:, at:at + n]
            now[:, after:] = self.going[:, after:n]
            if after:
                following = slice(self.at[t + 1], self.at[t + 1] + after)
                reached = step @ (self.emitted[:, following] * behind[:, following])
                now[:, :after] = reached / reached.sum(axis=0) if t % RESCALE == 0 else reached
            after = n
        share = self.ahead * behind
        whole = share.sum(axis=0)
        share /= whole
        started += share[:, :self.active[0]][:, self.first].sum(axis=1)
        for s in range(len(step)):
            all_emitted[:, s] += np.bincount(self.codes, share[s], len(all_emitted))
        # what a transition into a token carries, but for its origin and probability
        into = np.multiply(self.emitted, behind, out=behind)
        into /= whole * self.scale
        for t in range(1, len(self.active)):
            n, at, before = self.active[t], self.at[t], self.at[t - 1]
            moved += self.ahead[:, before:before + n] @ into[:, at:at + n].T
        inner = ~self.first
        moved += self.coming[:, inner] @ into[:, :self.active[0]][:, inner].T


def _grouped(batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Consecutive texts of about ``TOKENS`` tokens, with the number of the first."""
    first, held, size = 0, [], 0
    for i, codes in enumerate(batch.column(batch.schema.get_field_index("codes"))):
        held.append(np.frombuffer(codes.as_py(), np.uint16))
        size += len(held[-1])
        if size >= TOKENS:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def train(tokens: DataFrame, counts: Counts, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all texts that are not held out."""
    n_codes = len(counts.sizes)
    codes = tokens.where(~F.col("held_out")).select("codes")
    names = [f"s{i}" for i in range(states)]
    schema = "place int, " + ", ".join(f"{n} long" for n in names)
    model = first_model(counts.sizes, states)
    for _ in range(rounds):
        shared = codes.sparkSession.sparkContext.broadcast(model)  # n_codes x states numbers

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros((n_codes + states + 1, states))  # classes, then transitions, then starts
            for batch in batches:
                for _, texts in _grouped(batch):
                    total += np.vstack(Pieces(texts, shared.value, kind=np.float32).expected())
            whole = np.rint(total * UNIT).astype(np.int64)
            used = np.flatnonzero(whole.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), *(pa.array(whole[used, s]) for s in range(states))], ["place", *names])

        sums = np.zeros((n_codes + states + 1, states))
        for row in codes.mapInArrow(expect, schema).groupBy("place").agg(*(F.sum(n).alias(n) for n in names)).collect():
            sums[row[0]] = row[1:]  # at most n_codes + states + 1 rows
        sums /= UNIT
        model = next_model(counts.sizes, sums[:n_codes], sums[n_codes:-1], sums[-1])
    return model


@dataclass
class Frequent:
    """The frequent words, at most ``FREQUENT``, and the log10 of their counts plus one."""

    words: pa.Array
    gain: np.ndarray

    def places(self, flat: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words are frequent, and their places here."""
        found = pc.index_in(flat, value_set=self.words)
        there = found.is_valid().to_numpy(zero_copy_only=False)
        return there, found.drop_null().to_numpy()


def frequent_words(counts: Counts) -> Frequent:
    often = counts.words.where(F.col("c") * FREQUENT > counts.tokens).toArrow().combine_chunks()
    return Frequent(pa.array(often.column("word").to_pylist(), pa.string()), np.log10(often.column("c").to_numpy() + 1.0))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Row in the batch, word and number of all words of all texts."""
    words, ns = (batch.column(batch.schema.get_field_index(c)) for c in ("words", "ns"))
    return pc.list_parent_indices(words).to_numpy(), words.flatten(), ns.flatten()


def path_scores(tokens: DataFrame, model: Model, counts: Counts, often: Broadcast) -> DataFrame:
    """row, doc_id, held_out, n_tokens; n_often and often_score, of the frequent words; and path_score, the log10 likelihood
    of the classes of each text, each word being one of its class's size, plus one."""
    shared = tokens.sparkSession.sparkContext.broadcast((model, counts.sizes))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sizes = shared.value
        one_of = np.log10(np.append(sizes[:-1] + 1.0, 1.0))  # the end is alone in its class
        for batch in batches:
            size, found = [np.empty(0, np.int64)], [np.empty(0)]
            for _, texts in _grouped(batch):
                size.append(np.array([len(t) for t in texts], np.int64))
                inside = np.add.reduceat(one_of[np.concatenate(texts)], np.cumsum(size[-1]) - size[-1])
                found.append(Pieces(texts, model).likelihood() / np.log(10.0) - inside)
            row, words, ns = _flat(batch)
            there, place = often.value.places(words)
            row, n = row[there], ns.to_numpy()[there]
            known = np.bincount(row, n, batch.num_rows).astype(np.int64)
            gained = np.bincount(row, n * often.value.gain[place], batch.num_rows).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *map(pa.array, (np.concatenate(size), known, gained, np.concatenate(found)))],
                ["row", "doc_id", "held_out", "n_tokens", "n_often", "often_score", "path_score"])

    return tokens.select("row", "doc_id", "held_out", "codes", "words", "ns").mapInArrow(
        score, "row long, doc_id long, held_out boolean, n_tokens long, n_often long, often_score double, path_score double")


def rare_scores(tokens: DataFrame, counts: Counts, often: Broadcast) -> DataFrame:
    """of_row, n_rare (its known words that are not frequent) and rare_score (the log10 of their counts, plus one).

    Unknown words count as zero, plus one, and so add nothing.
    """
    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, words, ns = _flat(batch)
            there, _ = often.value.places(words)
            left = pa.array(np.flatnonzero(~there))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row).take(left)), words.take(left), ns.take(left)],
                                             ["of_row", "word", "n"])

    words = tokens.select("row", "words", "ns").mapInArrow(rare, "of_row long, word string, n int")
    known = counts.words.where(F.col("c") * FREQUENT <= counts.tokens).select(F.col("word").alias("known"), "c")
    return words.join(known, F.col("word") == F.col("known")).groupBy("of_row").agg(
        F.sum("n").alias("n_rare"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare_score"))


def score(docs: DataFrame, states: int = STATES, n_classes: int = N_CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs`` (doc_id, text).

    ``base_score`` is the text's log10 probability by single tokens, ``score`` by the hidden Markov model.
    """
    tokens = tokenised(docs, n_classes)
    counts = count_words(tokens, n_classes)
    model = train(tokens, counts, states, rounds)
    texts = counts.sizes[-1] - 1 if counts.sizes[-1] else 0  # every training text has one end
    end, all_tokens = float(np.log10(texts + 1)), float(np.log10(counts.tokens + counts.distinct + 1))
    often = docs.sparkSession.sparkContext.broadcast(frequent_words(counts))
    found = path_scores(tokens, model, counts, often).join(
        rare_scores(tokens, counts, often), F.col("row") == F.col("of_row"), "left")
    words = F.col("often_score") + F.coalesce("rare_score", F.lit(0.0))
    return found.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_often") + F.coalesce("n_rare", F.lit(0)) + int(texts > 0)).alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (words + end - F.col("n_tokens") * all_tokens).alias("base_score"), (words + F.col("path_score")).alias("score"))
