"""Plain versions of the corpus operators for small inputs."""

from __future__ import annotations

import re
from itertools import combinations

SPACE = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, words):
    w = re.findall(SPACE, (text or "").translate(LOWER))
    if not w:
        return frozenset()
    if len(w) < words:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i:i + words]) for i in range(len(w) - words + 1))


def roots(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def ngram_components(rows, words, per_cent):
    """rows: (doc_id, text), unique ids; returns {doc_id: (size, component, links)}."""
    rows = sorted(rows)
    sets = [shingles(t, words) for _, t in rows]
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    pairs = set()
    for members in where.values():
        pairs.update(combinations(members, 2))
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= per_cent * len(sets[a] | sets[b])]
    root = roots(len(rows), links)
    degree = [0] * len(rows)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    return {rows[i][0]: (len(sets[i]), rows[root[i]][0], degree[i]) for i in range(len(rows))}
