"""Secret scans: three fixed patterns, and a linear-chain CRF that tags tokens as begin, inside or outside.

Patterns run over the whole text. For the CRF a line is one sequence of tokens (runs of word characters and
``+/.-``, or single other characters); features are the token's shape, the kinds of the tokens around it and two
features of the file. Labels are decoded by Viterbi.

The CRF is fitted on lines with pattern matches from about ``sample`` documents, chosen by a hash of the text, on
copies of them with secrets of other forms, and on lines without any. The scores of all tokens of a text are table
look-ups. Most lines have no token whose scores, with the best transitions on either side, favour a secret: there all
*outside* is the best path, so only the other lines are decoded. The result is that of decoding all.

Defined cases: a null text is empty and has no spans; rows that repeat a doc_id are scanned each for itself; spans
are in code points, end exclusive; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .crf import ChainCRF

# The base patterns, in the order of their kinds.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")

SAMPLE = 150
BEGIN, INSIDE, OUTSIDE = 1, 2, 0
_TOKEN = re.compile(r"[\w+/.\-]+|[^\w\s+/.\-]")
_TOKEN_OR_END = re.compile(r"[\w+/.\-]+|[^\w\s+/.\-]|\n")
_KEYWORD = re.compile(r"(?i)passw|secret|token|api_?key|apikey|credential|auth|private|access_?key|^pwd$|^key$")
_HEX_ONLY = re.compile(r"[0-9a-f]+")
_KNOWN = re.compile(r"^(AKIA|ASIA|ghp_|gho_|github_pat_|sk-|sk_|pk_|xox[abp]-|eyJ|AIza|glpat-|hf_|npm_|SG\.)")
REACH = (-4, -3, -2, -1, 1, 2)
_CACHE = 500_000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, leftmost and non-overlapping for each kind."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def secret_values(text: str) -> list[tuple[int, int]]:
    """Where the secret itself stands in each base match."""
    out = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    return out + [(s, e) for s, k, e in base_spans(text) if k]


def kind_of(token: str) -> str:
    """The class of a token as its neighbours see it."""
    if len(token) == 1 and not token.isalnum():
        return {"=": "eq", ":": "colon", '"': "quote", "'": "quote"}.get(token, "mark")
    if _KEYWORD.search(token):
        return "keyword"
    if token.isdigit():
        return "digits"
    return "word" if token.strip(".-").isalpha() else "mixed"


def shape(token: str) -> list[str]:
    n = len(token)
    kind = kind_of(token)
    names = ["bias", f"kind={kind}", f"length={min(n.bit_length(), 8)}"]
    if n >= 6 and kind in ("mixed", "word", "digits"):
        low = token.lower()
        upper, lower = token != low, token != token.upper()
        digits = 0 if token.isalpha() else sum(map(str.isdigit, token))
        if not digits and token[1:] == low[1:]:
            turns = int(upper)
        else:
            turns = sum((a.isdigit() != b.isdigit()) or (a.isupper() != b.isupper()) for a, b in zip(token, token[1:]))
        names += [f"digits={min(4, 8 * digits // n)}", f"cases={upper:d}{lower:d}{digits > 0:d}",
                  f"variety={min(4, int(5 * len(set(token)) / min(n, 20)))}", f"turns={min(4, 8 * turns // n)}"]
        if digits and _HEX_ONLY.fullmatch(token):
            names.append("hex")
        if not token.isascii():
            names.append("foreign")
    if _KNOWN.match(token):
        names.append("known")
    return names


def file_features(text: str) -> list[str]:
    """Two features of the whole text: its share of assignment marks, and whether it speaks of keys."""
    marks = 1000 * (text.count("=") + text.count(":")) // (len(text) + 1)
    return [f"marks={min(marks.bit_length(), 4)}", f"keys={'key' in text or 'KEY' in text:d}"]


def line_features(tokens: list[str], whole: list[str]) -> list[list[str]]:
    kinds = [kind_of(t) for t in tokens]
    out = []
    for i, token in enumerate(tokens):
        around = [f"at{d}={kinds[i + d] if 0 <= i + d < len(kinds) else 'edge'}" for d in REACH]
        out.append(shape(token) + around + whole)
    return out


def _labels(spans: list[tuple[int, int]], values: list[tuple[int, int]]) -> list[int]:
    """BEGIN and INSIDE for tokens inside a secret."""
    out = []
    for start, end in spans:
        at = next((v for v in values if v[0] <= start and end <= v[1]), None)
        out.append(OUTSIDE if at is None else BEGIN if start == at[0] else INSIDE)
    for i, y in enumerate(out):
        if y == INSIDE and (i == 0 or out[i - 1] == OUTSIDE):
            out[i] = BEGIN
    return out


_ALPHABETS = (string.hexdigits[:16], string.ascii_letters + string.digits, string.ascii_uppercase + string.digits,
              string.ascii_letters + string.digits + "+/")
_NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey", "client_secret", "auth", "access_key")


def _digits(draw: random.Random, *sizes: int) -> list[str]:
    return ["".join(draw.choices(string.digits, k=n)) for n in sizes]


#: Texts that look a little like secrets: telephone numbers, addresses, dates, amounts, names of files and people.
_HARMLESS = (
    lambda d: "+{} ({}) {}-{}".format(*_digits(d, 1, 3, 3, 4)),
    lambda d: "{}-{}-{}".format(*_digits(d, 3, 3, 4)),
    lambda d: "user{}@mail{}.example.com".format(*_digits(d, 3, 1)),
    lambda d: "{}.{}.{}.{}".format(*_digits(d, 2, 3, 1, 2)),
    lambda d: "20{}-{}-{} {}:{}".format(*_digits(d, 2, 2, 2, 2, 2)),
    lambda d: "https://www.example.com/page/{}/index.html".format(*_digits(d, 4)),
    lambda d: "total = {}.{}".format(*_digits(d, 6, 2)),
    lambda d: "ReadMe_v{}.txt: SomeLongName".format(*_digits(d, 1)),
    lambda d: "{}".format(*_digits(d, d.randint(6, 16))),
)


def training_material(text: str, margin: int = 400) -> tuple[list[str], list[str], list[str]]:
    """File features, pieces of at most three lines with a match, and two pieces of lines without."""
    draw = random.Random(hashlib.sha256(text.encode()).digest())
    hit, plain = [], []
    for line in text.split("\n"):
        values = secret_values(line)
        if values and len(hit) < 3:
            hit.append(line[max(0, values[0][0] - margin):values[0][1] + margin])
        elif line and not values:
            plain.append(line)
    pieces = []
    for line in draw.sample(plain, min(2, len(plain))):
        at = draw.randrange(len(line))
        pieces.append(line[max(0, at - margin):at + margin])
    return file_features(text), hit, pieces


def training_lines(material: list[tuple[list[str], list[str], list[str]]]) -> tuple[list[list[list[str]]], list[list[int]]]:
    """Sequences and labels: lines with matches, copies with secrets of other forms, and lines without any."""
    sequences, labels = [], []

    def add(line: str, values: list[tuple[int, int]], whole: list[str], middle: int) -> None:
        spans = [m.span() for m in _TOKEN.finditer(line)]
        near = min(range(len(spans)), key=lambda i: abs(spans[i][0] - middle), default=0)
        spans = spans[max(0, near - 10):near + 10]
        if spans:
            sequences.append(line_features([line[a:b] for a, b in spans], whole))
            labels.append(_labels(spans, values))

    for number, (whole, hit, plain) in enumerate(sorted(material)):
        draw = random.Random(number)
        for line in hit:
            values = secret_values(line)
            if not values:
                continue
            add(line, values, whole, values[0][0])
            start, end = values[0]
            value = draw.choice(("", "", "", "AKIA", "ghp_", "sk-")) + "".join(
                draw.choices(draw.choice(_ALPHABETS), k=draw.randint(16, 44)))
            add(line[:start] + value + line[end:], [(start, start + len(value))], whole, start)
            first = (line.split() or ["key"])[0]
            bare = f"{first} {draw.choice(_NAMES)}{draw.choice((' = ', '=', ': '))}"
            add(bare + value, [(len(bare), len(bare) + len(value))], whole, len(bare))
        for line in plain:
            add(line, [], whole, draw.randrange(len(line)))
            words = line.split() or ["text"]
            word = draw.choice(words)
            about = f"{word} {draw.choice(_NAMES)} {draw.choice(('is', '=', ':', word))} {word}"
            add(about, [], whole, len(about) // 2)
            cut = draw.randrange(len(words))
            lead, quote = " ".join(words[max(0, cut - 12):cut]), draw.choice(("", '"', "'"))
            harmless = draw.choice(_HARMLESS)(draw)
            start = " ".join(words[max(0, cut - 12):cut])
            add(f"{start} {harmless} {' '.join(words[cut:cut + 12])}", [], whole, len(start) + 1)
            if draw.random() < 0.7:
                lead += f" {draw.choice(_NAMES)}{draw.choice((' = ', '=', ': ', ' : '))}{quote}"
                value = "".join(draw.choices(draw.choice(_ALPHABETS), k=draw.choice((draw.randint(8, 15), draw.randint(16, 44)))))
            else:
                lead += " "
                value = draw.choice(("AKIA", "ghp_", "sk-", "xoxb-")) + "".join(draw.choices(_ALPHABETS[1], k=draw.randint(16, 40)))
                quote = ""
            add(f"{lead}{value}{quote} {' '.join(words[cut:cut + 12])}", [(len(lead), len(lead) + len(value))], whole, len(lead))
    return sequences, labels


#: The kinds of tokens; the first stands for whatever lies beyond a line's ends.
TOKEN_KINDS = ("edge", "eq", "colon", "quote", "mark", "keyword", "digits", "word", "mixed")
_KIND_NUMBER = {kind: i for i, kind in enumerate(TOKEN_KINDS)}


@dataclass
class SecretModel:
    crf: ChainCRF

    def __post_init__(self):
        self.taught = bool(self.crf.features)
        if not self.taught:
            return
        self.around = {d: np.array([self.crf.vector([f"at{d}={kind}"]) for kind in TOKEN_KINDS]) for d in REACH}
        # a run of m tokens in a secret changes m + 1 transitions, at most two for each token
        moves = self.crf.moves
        best = max(float(moves[a, b]) for a in range(3) for b in range(3) if (a, b) != (OUTSIDE, OUTSIDE))
        self.step = 2 * max(0.0, best - float(moves[OUTSIDE, OUTSIDE]), float(max(self.crf.start[1:]) - self.crf.start[OUTSIDE]))


def _material(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [training_material(t) for t in batch.column("text").to_pylist()]
        lists = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column("draw"), *[pa.array([f[i] for f in found], lists) for i in range(3)]],
            ["draw", "whole", "hit", "plain"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> SecretModel:
    """Fit on at most ``sample`` documents (text) with a base match and as many without.

    They are taken in the order of a hash, from a slice of about ``60 * sample`` documents.
    """
    drawn = docs.select("text").where("text IS NOT NULL AND length(text) > 0").withColumn("draw", F.xxhash64("text"))
    share = min(1.0, 60 * sample / max(docs.count(), 1))
    limit = min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))
    found = stored(drawn.where(F.col("draw") <= limit).mapInArrow(
        _material, "draw long, whole array<string>, hit array<string>, plain array<string>"), "secret-sample")
    chosen = [found.where((F.size("hit") > 0) == wanted).orderBy("draw", "hit", "plain").limit(sample) for wanted in (True, False)]
    rows = [tuple(r[1:]) for part in chosen for r in part.collect()]  # at most 2 x sample rows of five short pieces
    sequences, labels = training_lines(rows)
    crf = ChainCRF(3, forbidden=((OUTSIDE, INSIDE),), forbidden_start=(INSIDE,))
    return SecretModel(crf.fit(sequences, labels))


class Scanner(dict):
    """Row of each token in tables of scores and kinds; tokens are added when first met."""

    def __init__(self, model: SecretModel):
        super().__init__()
        self.model = model
        self.scores, self.kinds = np.zeros((1024, 3)), np.zeros(1024, np.int64)
        self.shapes: dict[tuple[str, ...], np.ndarray] = {}  # few: features have few values
        self.restart()

    def restart(self) -> None:
        self.clear()
        self["\n"] = 0  # of kind "edge"

    def __missing__(self, token: str) -> int:
        at = len(self)
        if at == len(self.scores):
            self.scores, self.kinds = (np.concatenate([x, np.zeros_like(x)]) for x in (self.scores, self.kinds))
        names = tuple(shape(token))
        vector = self.shapes.get(names)
        if vector is None:
            vector = self.shapes[names] = self.model.crf.vector(names)
        self.scores[at], self.kinds[at] = vector, _KIND_NUMBER[names[1][5:]]
        self[token] = at
        return at

    def emissions(self, tokens: list[str], whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of each token's labels, and the line it is in; an end of a line begins the next."""
        at = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        kinds = self.kinds[at]
        line = np.cumsum(kinds == 0)
        emit = self.scores[at] + whole
        for d in REACH:
            near = np.zeros(len(kinds), np.int64)
            to, of = (slice(-d, None), slice(None, d)) if d < 0 else (slice(None, -d), slice(d, None))
            near[to] = np.where(line[to] == line[of], kinds[of], 0)
            emit += self.model.around[d][near]
        return emit, line

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the tagged secrets."""
        if not self.model.taught:
            return []
        if len(self) > _CACHE:
            self.restart()
        tokens = _TOKEN_OR_END.findall(text)
        if not tokens:
            return []
        emit, line = self.emissions(tokens, self.model.crf.vector(file_features(text)))
        gain = np.maximum(emit[:, BEGIN], emit[:, INSIDE]) - emit[:, OUTSIDE] + self.model.step
        open_lines = np.unique(line[gain > 0])
        if not len(open_lines):
            return []
        places, found = [m.span() for m in _TOKEN_OR_END.finditer(text)], []
        for number in open_lines:
            low, high = np.searchsorted(line, (number, number + 1))
            low += tokens[low] == "\n"
            if low < high:
                found += self._decode(emit[low:high], places[low:high])
        return found

    def _decode(self, emit: np.ndarray, places: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        out: list[list[int]] = []
        for (start, end), y in zip(places, self.model.crf.viterbi(emit)):
            if y == BEGIN or (y == INSIDE and not out):
                out.append([start, 3, end])
            elif y == INSIDE:
                out[-1][2] = end
        return [tuple(x) for x in out]

    def decode_line(self, line: str, whole: np.ndarray) -> list[tuple[int, int, int]]:
        """One line decoded without a look at what it could gain."""
        places = [m.span() for m in _TOKEN.finditer(line)]
        return self._decode(self.emissions([line[a:b] for a, b in places], whole)[0], places) if places else []


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                text = text or ""
                base = base_spans(text)
                kinds = [k for _, k, _ in base]
                rows.append((doc, *[kinds.count(k) for k in range(3)], hashlib.sha256(listed(base).encode()).hexdigest(),
                             listed(sorted(base + scanner.spans(text)))))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 4, pa.string(), pa.string()))],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def scan(docs: DataFrame, model: SecretModel) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of ``docs`` (doc_id, text); nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _scan(shared), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
