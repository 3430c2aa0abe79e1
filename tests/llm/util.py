"""Brute-force versions and small hard tables for the training-data operators."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, sources=None, ids=None):
    ids = ids or list(range(len(texts)))
    sources = sources or ["s0"] * len(texts)
    rows = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in zip(ids, texts, sources)]
    return spark.createDataFrame(rows, SCHEMA)


def hard_texts(seed: int = 5) -> list[str | None]:
    """Nulls, empties, runs, copies, near copies, shared passages, non-ASCII and a very long text."""
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)] + ["été", "ñandú", "中文", "😀x"]
    words = lambda n: [r.choice(vocab) for _ in range(n)]
    passage = words(70)
    base = words(300)
    out: list[str | None] = [None, "", " \n\t ", "one", "two words", "A b C d e"]
    out += [" ".join(base)] * 3
    for _ in range(4):
        near = list(base)
        near[r.randrange(300)] = "changed"
        out.append(" ".join(near))
    for _ in range(4):
        out.append("\n".join([" ".join(words(60)), " ".join(passage), " ".join(words(40))]))
    out += ["same " * 200, "same " * 90, "ab" * 400, "ab" * 120 + "x", " ".join(words(20000)), "\n".join(["line of five plain words"] * 30)]
    return out


def brute_bytes(rows, length=50):
    least: dict[bytes, int] = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            k = b[s : s + length]
            if k not in least or i < least[k]:
                least[k] = i
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if least[b[s : s + length]] < i:
                gone[s : s + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone) if not y)
        runs = sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(rows, window=35):
    words = [WORD.findall(t or "") for _, t in rows]
    counts = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for s in range(len(w) - window + 1):
            if counts[tuple(w[s : s + window])] > 1:
                gone.update(range(s, s + window))
        kept = [x for p, x in enumerate(w) if p not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_near(rows, k=4, percent=80):
    """doc_id -> (set size, component)"""
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}
