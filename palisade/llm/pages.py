"""Main text of web pages by a linear-chain CRF over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between the starts and ends of block-level elements. Each block has
features of its ancestors (tags, words of their classes and ids) and of its text (length, share of links,
punctuation). A CRF with the labels *other* and *main* is decoded by Viterbi.

It is fitted on labelled pages: about ``sample`` of all pages of the input that mark their article as such (``article`` or
``main``; what a menu, header, footer, sidebar, form or comment list holds inside is *other*), and on the same
blocks laid out anew by a set of labelled layouts, so that classes and ids count as well as tags. Without such
pages it is fitted on those layouts with texts of any pages.

Defined cases: null or empty html has an empty text; text of scripts, styles and templates is markup; an unclosed
element ends with its parent, a paragraph at the next block; rows that repeat a page_id are read each for itself;
an empty table gives no rows.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .crf import ChainCRF

SAMPLE = 300
OTHER, MAIN = 0, 1

# Element names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body button canvas caption center dd details dialog div dl dt fieldset figcaption "
            "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav noscript object "
            "ol option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split())
SKIPPED = set("script style template noscript svg iframe object canvas".split())
CLOSES_P = BLOCK - set("html head body title button label option".split())

# Words of classes and ids, by what they stand for.
CLASS_WORDS = {
    "ad": "ad ads advert adverts advertisement advertising banner promo promotion promoted sponsor sponsored dfp adsense",
    "comment": "comment comments reply replies disqus discussion respond responses",
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs pagination pager toc tabs skip links sitemap",
    "side": "sidebar side aside rail widget widgets related recommended recommendations popular trending more tags share "
            "social sharing newsletter subscribe signup",
    "frame": "header footer masthead topbar bottom copyright legal site logo branding",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay warning message toast disclaimer",
    "form": "form search login register input contact",
    "main": "article content main post entry story body text page prose single",
}
_CLASS_OF = {word: group for group, words in CLASS_WORDS.items() for word in words.split()}
_SPACE = re.compile(r"\s+")
_NOT_LETTER = re.compile(r"[^a-z]+")


@dataclass
class Block:
    path: tuple[tuple[str, tuple[str, ...]], ...]
    text: str
    link_chars: int


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.path: list[tuple[str, tuple[str, ...]]] = []
        self.parts: list[str] = []
        self.links, self.in_link, self.skip = 0, 0, None
        self.inner: list[str] = []  # elements open inside a skipped one
        self.out: list[Block] = []

    def cut(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.out.append(Block(tuple(self.path), text, self.links))
        self.parts, self.links = [], 0

    def handle_starttag(self, tag, attrs):
        if self.skip:
            if tag in BLOCK and tag not in VOID:
                self.inner.append(tag)
            return
        if tag in SKIPPED:
            self.skip, self.inner = tag, []
            return
        if tag == "a":
            self.in_link = 1
        if tag == "br":
            self.parts.append(" ")
        if tag not in BLOCK:
            return
        self.cut()
        self.in_link = 0
        if tag in CLOSES_P and self.path and self.path[-1][0] == "p":
            self.path.pop()
        if tag in ("li", "dt", "dd", "option", "tr", "td", "th") and self.path and self.path[-1][0] == tag:
            self.path.pop()
        if tag not in VOID:
            words = [w for k, v in attrs if k in ("class", "id", "role") and v for w in _NOT_LETTER.split(v.lower()) if w]
            self.path.append((tag, tuple(words)))

    def handle_startendtag(self, tag, attrs):
        if tag in VOID or tag in BLOCK:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.skip:
            if tag in self.inner:
                while self.inner.pop() != tag:
                    pass
            elif tag == self.skip:
                self.skip = None
            elif any(t == tag for t, _ in self.path):  # the end of an element around it: the skipped one was never closed
                self.skip = None
                self.handle_endtag(tag)
            return
        if tag == "a":
            self.in_link = 0
        if tag in BLOCK:
            self.cut()
            if any(t == tag for t, _ in self.path):
                while self.path.pop()[0] != tag:
                    pass

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)
            if self.in_link:
                self.links += len(data)


def blocks_of(html: str) -> list[Block]:
    """The leaf blocks of a page, in order; character references are decoded, white space is one space."""
    reader = _Blocks()
    reader.feed(html)
    reader.close()
    reader.cut()
    return reader.out


def features(blocks: list[Block]) -> list[list[str]]:
    out = []
    for i, b in enumerate(blocks):
        tags = [t for t, _ in b.path]
        groups = {_CLASS_OF[w] for _, words in b.path for w in words if w in _CLASS_OF}
        n = len(b.text)
        names = ["bias", f"tag={tags[-1] if tags else 'none'}", *[f"in={t}" for t in set(tags)],
                 *[f"class={g}" for g in groups], f"length={min(n.bit_length(), 10)}",
                 f"links={min(4, 4 * b.link_chars // n)}", f"stop={b.text[-1] in '.!?:;\"”»…'}",
                 f"edge={'first' if i == 0 else 'last' if i == len(blocks) - 1 else 'no'}"]
        if "©" in b.text or "cookie" in b.text.lower():
            names.append("boilerplate")
        out.append(names)
    return out


_OUT_TAGS = {"nav", "header", "footer", "aside", "form", "button", "select", "textarea", "head", "title", "dialog", "menu"}
_OUT_CLASSES = {"ad", "comment", "menu", "side", "notice", "form"}


def marked_labels(blocks: list[Block]) -> list[int] | None:
    """Labels that the page's own article element gives; None for a page without one."""
    out = []
    for b in blocks:
        tags = [t for t, _ in b.path]
        at = max((i for i, t in enumerate(tags) if t in ("article", "main")), default=None)
        within = b.path[at:] if at is not None else ()
        shut = any(t in _OUT_TAGS or any(_CLASS_OF.get(w) in _OUT_CLASSES for w in words) for t, words in within)
        out.append(MAIN if at is not None and not shut else OTHER)
    return out if MAIN in out else None


# Labelled layouts. Each line is a place in a page (tag.class ...), what stands there, and its label.
LAYOUTS = """
header.site-header div.logo | short | other
nav.main-menu ul li | link | other
div.cookie-notice p | plain | other
div#content article h1 | title | main
div#content article p | prose | main
div#content article blockquote p | prose | main
div#content article ul li | plain | main
div#content article div.ad-slot p | plain | other
div#content article aside.related ul li | link | other
div#content article section.comments h3 | short | other
div#content article section.comments div.comment p | plain | other
aside.sidebar ul li | link | other
footer.site-footer p | short | other

div#header div.branding | short | other
div#menu ul li | link | other
div.breadcrumb | link | other
div.banner-ad p | plain | other
main div.post h1 | title | main
main div.post div.entry-content p | prose | main
main div.post div.entry-content h2 | title | main
main div.post div.entry-content table tr td | plain | main
main div.post div.share-links | link | other
div#comments div.comment-body p | plain | other
div#respond form label | short | other
div#sidebar div.widget p | plain | other
div#footer div.copyright | short | other

div.topbar ul li | link | other
div.consent-popup div p | plain | other
div.page div.story h1 | title | main
div.page div.story p | prose | main
div.page div.story pre | plain | main
div.page div.story figure figcaption | plain | main
div.page div.story div.promo p | plain | other
div.page div.newsletter form label | short | other
div.page div.disqus div.reply p | prose | other
div.page div.recommended a | link | other
footer div.legal p | plain | other
""".strip()


def _layouts() -> list[list[tuple[tuple, str, int]]]:
    out = []
    for page in LAYOUTS.split("\n\n"):
        lines = []
        for line in page.split("\n"):
            place, what, label = (x.strip() for x in line.split("|"))
            path = [("html", ()), ("body", ())]
            for step in place.split():
                tag, *words = re.split(r"[.#]", step)
                path.append((tag, tuple(w for word in words for w in word.split("-"))))
            lines.append((tuple(path), what, MAIN if label == "main" else OTHER))
        out.append(lines)
    return out


def laid_out(texts: list[str], draw: random.Random) -> tuple[list[Block], list[int]]:
    """The main texts of a page in one of the layouts, with other texts around them."""
    blocks, labels = [], []
    words = " ".join(texts).split() or ["text"]
    for path, what, label in draw.choice(_layouts()):
        for _ in range(draw.randint(1, 3) if what in ("prose", "link") else draw.randint(0, 1) if what != "title" else 1):
            n = {"short": 4, "link": 2, "title": 8, "plain": draw.randint(3, 25), "prose": 0}[what]
            at = draw.randrange(len(words))
            text = draw.choice(texts) if what == "prose" else " ".join(words[at:at + n]) or words[0]
            blocks.append(Block(path, text, len(text) if what == "link" else 0))
            labels.append(label)
    return blocks, labels


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features and labels of marked pages and of their texts in other layouts; short rows however long the page."""
    for batch in batches:
        keys, names, labels = [], [], []
        for key, html in zip(batch.column("draw").to_pylist(), batch.column("html").to_pylist()):
            blocks = blocks_of(html)
            marked = marked_labels(blocks)
            if marked is None:
                continue
            draw = random.Random(key)
            main = [b.text for b, y in zip(blocks, marked) if y == MAIN]
            for b, y in ((blocks, marked), laid_out(main, draw), laid_out(main, draw)):
                start = draw.randrange(max(1, len(b) - 60))
                keys.append(key)
                names.append(["\n".join(f) for f in features(b)[start:start + 60]])
                labels.append(y[start:start + 60])
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(labels, pa.list_(pa.int32()))],
            ["draw", "names", "labels"])


def _sampled_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features and labels of layouts with the longer texts of any pages."""
    for batch in batches:
        keys, names, labels = [], [], []
        for key, html in zip(batch.column("draw").to_pylist(), batch.column("html").to_pylist()):
            texts = [b.text for b in blocks_of(html)]
            texts = [t for t in texts if len(t.split()) >= 10] or texts
            if not texts:
                continue
            draw = random.Random(key)
            for b, y in (laid_out(texts, draw), laid_out(texts, draw)):
                keys.append(key)
                names.append(["\n".join(f) for f in features(b)[:60]])
                labels.append(y[:60])
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(labels, pa.list_(pa.int32()))],
            ["draw", "names", "labels"])


def _drawn(pages: DataFrame, sampled, sample: int) -> DataFrame:
    """The rows that ``sampled`` makes of a share of the pages, which grows until they are enough or all are read."""
    pages = pages.withColumn("draw", F.xxhash64("html"))
    share = min(1.0, sample / max(pages.count(), 1))
    while True:
        limit = min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))
        rows = stored(pages.where(F.col("draw") <= limit).mapInArrow(
            sampled, "draw long, names array<string>, labels array<int>"), "page-sample")
        found = rows.count()
        if share >= 1 or found >= sample:
            return rows
        share = min(1.0, share * max(2.0, min(64.0, 3 * sample / max(found, 1))))


def fit(pages: DataFrame, sample: int = SAMPLE) -> ChainCRF:
    """Fit on about ``sample`` marked pages (html) of the whole table, taken by a hash of their html.

    Without a marked page the layouts are fitted with texts of any pages.
    """
    pages = pages.select("html").where("html IS NOT NULL")
    rows = _drawn(pages.where(F.col("html").rlike("(?i)<(article|main)")), _sampled, sample)
    if rows.isEmpty():
        rows = _drawn(pages, _sampled_texts, sample)
    rows = rows.orderBy("draw", "names", "labels").limit(3 * sample).collect()
    crf = ChainCRF(2)
    return crf.fit([[f.split("\n") for f in r.names] for r in rows], [r.labels for r in rows])


class Extractor:
    def __init__(self, crf: ChainCRF):
        self.crf, self.known = crf, {}

    def _score(self, name: str):
        v = self.known.get(name)
        if v is None:
            v = self.known[name] = self.crf.vector([name])
        return v

    def main_text(self, html: str | None) -> str:
        blocks = blocks_of(html) if html else []
        if not blocks or not self.crf.features:
            return ""
        emit = np.array([sum(map(self._score, names)) for names in features(blocks)])
        return "\n\n".join(b.text for b, y in zip(blocks, self.crf.viterbi(emit)) if y == MAIN)


def _extract(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor(shared.value)
        for batch in batches:
            texts = [extractor.main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, crf: ChainCRF) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages`` (page_id, url, html); nothing is shuffled."""
    shared = pages.sparkSession.sparkContext.broadcast(crf)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(
        _extract(shared), "page_id long, url string, text string, n_chars long")
