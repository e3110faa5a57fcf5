"""Brute-force versions of the operators, and a table of awkward documents."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mark string, words int, shard string, sketch string, route string, key string"


def words(text):
    return WORD.findall(text or "")


def awkward_rows():
    """Copies, near copies, shared passages, nulls, empty, short and very long texts, repeated rows, clashing names."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdeéß", k=rng.randint(2, 6))) for _ in range(400)]
    fresh = lambda n: rng.choices(vocabulary, k=n)
    passage, base = fresh(60), fresh(300)
    texts = [base, base, base[:150] + ["changed"] + base[151:], base[:280], fresh(40) + passage + fresh(40), passage + fresh(10), fresh(80) + passage[:13], fresh(5), fresh(4), fresh(1), fresh(12) * 30, ["the"] * 500, fresh(20_000)]
    texts += [base[:i] + fresh(1) + base[i + 1 :] for i in range(10, 200, 10)]
    rows = [(100 - i if i % 2 else 200 + i, (" " if i % 3 else "\n\t").join(t)) for i, t in enumerate(texts)]
    rows += [(1, None), (2, ""), (3, " \n "), (4, "İstanbul <|endoftext|> naïve don't 12ab x 　y"), (None, " ".join(base)), (None, None), (5, "x" * 30_000), (6, "x" * 30_000)]
    rows += [rows[4], rows[0]]  # repeated rows
    return [(i, t, ("en", "fr", None)[k % 3], ("a", "b", "é", None)[k % 4], len(t or ""), "m", 1, "s", "k", "r", "key") for k, (i, t) in enumerate(rows)]


def removed_words(rows, window=13):
    """``(doc_id, text)`` to (n_words, n_removed, hash of what stays)."""
    first = {}
    for i, text in rows:
        w = words(text)
        for k in range(len(w) - window + 1):
            if i is not None:
                known = first.get(tuple(w[k : k + window]))
                first[tuple(w[k : k + window])] = i if known is None or i < known else known
    out = []
    for i, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def similarity_classes(rows, threshold=0.8):
    """Multiset of (doc_id, class_id, n_links)."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for a, (i, s) in enumerate(sets):
        for b in range(a):
            j, t = sets[b]
            if i is not None and j is not None and s and t and len(s & t) / len(s | t) >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return Counter((i, find(i) if i is not None else None, links[a]) for a, (i, _) in enumerate(sets))
