"""Plain Python versions of the corpus contracts."""

import collections
import hashlib
import re

ALPHA = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE = " \t\n\r\x0b\x0c"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def components(rows, n=5):
    """[(n_shingles, component_id)] of [(doc_id, text)]; ids as they are, rows apart."""
    sets = []
    for _, t in rows:
        w = words(lower(t or ""))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(len(s), least.get(find(i)) if s else rows[i][0]) for i, s in enumerate(sets)]


def without_repeats(texts, k=35):
    """[(n_words, n_removed, sha of what is kept)]"""
    split = [words(t) for t in texts]
    count = collections.Counter(tuple(w[i : i + k]) for w in split for i in range(len(w) - k + 1))
    out = []
    for w in split:
        gone = {j for i in range(len(w) - k + 1) if count[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        out.append((len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def contamination(texts, items, n=13):
    """[(n_words, n_hit, sorted ids of items)]"""
    grams = collections.defaultdict(set)
    for item, t in items:
        w = ALPHA.findall(lower(t or ""))
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            grams[tuple(w[i : i + size])].add(item)
    sizes = {len(g) for g in grams}
    out = []
    for t in texts:
        w = ALPHA.findall(lower(t or ""))
        hit, ids = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                found = grams.get(tuple(w[i : i + size]))
                if found:
                    hit |= set(range(i, i + size))
                    ids |= found
        out.append((len(w), len(hit), sorted(str(x) for x in ids if x is not None)))
    return out


def without_lines(texts, least=10, ids=None):
    """[(n_lines, n_dropped, kept text)]; rows of one id are one document, those without id each their own."""
    key = lambda x: lower(x.strip(SPACE))
    held = collections.defaultdict(set)
    for i, t in enumerate(texts):
        for k in {key(x) for x in (t or "").split("\n")} - {""}:
            held[k].add(("row", i) if ids is None or ids[i] is None else ids[i])
    count = collections.Counter({k: len(v) for k, v in held.items()})
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if count[key(x)] < least]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out
