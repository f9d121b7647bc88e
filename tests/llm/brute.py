"""Plain Python versions of the corpus operators, for small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

UP = {ord(a): a.lower() for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PLAIN = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return (text or "").translate(UP)


def words(text):
    return WORD.findall(lower(text))


def draw(key, seed):
    return int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:13], 16) / 2 ** 52


def targets(sizes):
    """sizes: source -> words. Raise all sources by weight; those at their limit stay there."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in full]
        left = total - sum(full.values())
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest} if rest else {}
        over = [s for s in rest if share[s] >= 3 * sizes[s]]
        if not over:
            return full | share
        full |= {s: 3.0 * sizes[s] for s in over}


def mixed(docs):
    """(doc, copies, source size, target) of dicts with doc_id, text, source."""
    size = [len(PLAIN.findall(d["text"] or "")) for d in docs]
    per = defaultdict(int)
    for d, n in zip(docs, size):
        per[d["source"]] += n
    goal, out = targets(per), []
    for d, n in zip(docs, size):
        rate = goal[d["source"]] / per[d["source"]] if per[d["source"]] else 0.0
        key = str(d["doc_id"]) if d["doc_id"] is not None else "text:" + (hashlib.md5(d["text"].encode()).hexdigest() if d["text"] is not None else "")
        out.append((d, n, math.floor(rate) + (draw(key, "mix") < rate - math.floor(rate)), per[d["source"]], goal[d["source"]]))
    return out


def shard(key, n):
    score = [-1 / math.log(draw(f"{'null' if key is None else key}:{s}", "shard") + 2.0 ** -53) for s in range(n)]
    return score.index(max(score))


def shingles(text, width):
    w = PLAIN.findall(lower(text))
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def components(docs, width):
    """(n_shingles, least id reached) for each (id, text)."""
    sets = [shingles(t, width) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return [(len(s), least[root(i)]) for i, s in enumerate(sets)]


def windows(text, width=10):
    w = words(text)
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def contamination(text, items):
    """n_words, n_hit, sorted items."""
    w, hit, found = words(text), set(), set()
    for item, other in items:
        for g in windows(other):
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i:i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    found.add("null" if item is None else str(item))
    return len(w), len(hit), sorted(found)


def line_dedup(docs):
    """(doc_id, n_lines, n_dropped, kept text) for (doc_id, text)."""
    key = lambda x: lower(x.strip(" \t\n\v\f\r"))
    held = defaultdict(set)
    for doc, text in docs:
        for x in (text or "").split("\n"):
            if len(key(x)) >= 10:
                held[key(x)].add(math.inf if doc is None else doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(held[key(x)]) < 2 or (math.inf if doc is None else doc) == min(held[key(x)])]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def base_places(text):
    """n_words, starts and labels of the license phrases."""
    w, starts, labels = words(text), [], set()
    for phrase, label in {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i:i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(w), sorted(starts), sorted(labels)


def rows(df):
    return Counter(tuple(r) for r in df.collect())
