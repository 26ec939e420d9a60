"""Plain Python forms of the operators, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ITEMS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORDS.findall(text or "")


def lower_words(text):
    return words((text or "").translate(LOWER))


def corpus(seed=3, n=60):
    """(doc_id, text): random texts over few words, copies, near copies, shared passages, nulls, empty ones, ties."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 9 == 0 else f"W{i}" for i in range(400)]
    make = lambda k: [rnd.choice(vocabulary) for _ in range(k)]
    passage = make(60)
    docs = []
    for i in range(n):
        kind = i % 6
        if kind == 0 or not docs:
            w = make(rnd.randint(1, 120))
        elif kind == 1:
            w = (docs[rnd.randrange(len(docs))][1] or "x").split()
        elif kind == 2:
            w = (docs[rnd.randrange(len(docs))][1] or "x y z").split()
            for _ in range(max(1, len(w) // 50)):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        elif kind == 3:
            w = make(rnd.randint(0, 30)) + passage + make(rnd.randint(0, 30))
        elif kind == 4:
            w = make(rnd.randint(0, 6))
        else:
            w = (make(3) * 40)[: rnd.randint(1, 120)]
        docs.append((i, " ".join(w) if rnd.random() < 0.7 else "\n".join(w)))
    docs += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, docs[0][1]), (n + 3, docs[0][1]), (n + 4, "one two three four five six seven eight nine ten " * 3)]
    return docs


def classes(docs, n=5, percent=75):
    """doc_id -> (set size, class)"""
    sets = collections.defaultdict(list)
    for d, t in docs:
        w = lower_words(t)
        sets[d].append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                a_, b_ = find(a), find(b)
                up[max(a_, b_)] = min(a_, b_)
    return {d: find(d) for d in ids}


def repeated_words(docs, width=35):
    """(n_words, n_removed, kept hash) of each row, in order"""
    seen = collections.Counter()
    split = [words(t) for _, t in docs]
    for w in split:
        seen.update(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


def repeated_bytes(docs, length=200):
    """(n_bytes, n_removed, n_spans, kept hash) of each row, in order"""
    raw = [(t or "").encode() for _, t in docs]
    seen = collections.Counter()
    for b in raw:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def benchmark_hits(docs, items, span=10):
    """(n_words, n_hit, item ids hash) of each row, in order"""
    table = collections.defaultdict(set)
    for i, t in items:
        w = ITEMS.findall((t or "").translate(LOWER))
        k = min(span, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            table[tuple(w[a : a + k])].add(str(i))
    widths = sorted({len(k) for k in table})
    out = []
    for _, t in docs:
        w = ITEMS.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for k in widths:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in table:
                    hit.update(range(a, a + k))
                    found |= table[tuple(w[a : a + k])]
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return out
