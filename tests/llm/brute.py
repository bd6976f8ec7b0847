"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

WS = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WS.findall(text or "")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, size):
    w = words(lowered(text))
    if not w:
        return frozenset()
    size = min(size, len(w))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def near(docs, size, percent=80):
    """(id, n_shingles, component_id, kept) rows of distinct ids, comparing all pairs that share a shingle."""
    sets = {i: shingle_set(t, size) for i, t in docs}
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    common = Counter(p for v in by.values() for p in itertools.combinations(sorted(set(v)), 2))
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets.items())


def repeats(docs, size):
    """(id, n_words, n_removed, kept text) rows."""
    least = {}
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            if i is not None:
                least[key] = min(least.get(key, i), i)
    out = []
    for i, t in docs:
        w, gone = words(t), set()
        for k in range(len(w) - size + 1):
            if i is not None and least[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


NAME = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in NAME.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    n = Counter(k for _, k, _ in found)
    listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))
    return n[0], n[1], n[2], hashlib.sha256(listed.encode()).hexdigest()


def segments(gains):
    """All maximal scoring segments by definition: recursively the best segment, then both sides."""
    best, where = 0.0, None
    for i in range(len(gains)):
        total = 0.0
        for j in range(i, len(gains)):
            total += gains[j]
            if total > best + 1e-9:
                best, where = total, (i, j + 1)
    if where is None:
        return []
    i, j = where
    left = segments(gains[:i])
    right = [(s, a + j, b + j) for s, a, b in segments(gains[j:])]
    return [*left, (best, i, j), *right]


def bins_needed(lengths, capacity):
    return math.ceil(sum(lengths) / capacity)
