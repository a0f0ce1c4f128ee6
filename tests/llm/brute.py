"""Slow, plain versions of what the operators compute."""

import hashlib
import itertools
import re
from collections import Counter


def tokens(text):
    return (text or "").encode().lower().split()


def shingles(text, size):
    w = tokens(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i: i + size]) for i in range(max(1, len(w) - size + 1)))


def roots(n, pairs):
    """Smallest reachable index of each of n nodes."""
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def near_groups(texts, size, percent):
    sets = [shingles(t, size) for t in texts]
    return roots(len(texts), [
        (i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j]
        and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])])


def repeated_bytes(texts, span):
    """For each text: (bytes, removed, runs, digest of the rest), by comparing every string with every other."""
    out = []
    for d, gone in zip(*covered_bytes(texts, span), strict=True):
        runs = sum(g and not b for g, b in zip(gone, [False, *gone]))
        kept = bytes(x for x, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def covered_bytes(texts, span):
    """The bytes of each text and, for each byte, whether a string of ``span`` bytes over it stands anywhere else."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i: i + span] for d in data for i in range(len(d) - span + 1))
    marks = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - span + 1):
            if seen[d[i: i + span]] > 1:
                gone[i: i + span] = [True] * span
        marks.append(gone)
    return data, marks


def without_passages(texts, span, words):
    """The texts without bytes that strings of ``span`` bytes or of ``words`` words repeat; a character goes whole."""
    data, marks = covered_bytes(texts, span)
    places = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", d)] for d in data]
    runs = [[tuple(d[a:b] for a, b in place[i: i + words]) for i in range(len(place) - words + 1)] for d, place in zip(data, places)]
    seen = Counter(r for own in runs for r in own)
    out = []
    for d, gone, place, own in zip(data, marks, places, runs):
        for i, run in enumerate(own):
            if seen[run] > 1:
                a, b = place[i][0], place[i + words - 1][1]
                gone[a:b] = [True] * (b - a)
        parts = [bytes(x for x, _ in g) for cut, g in itertools.groupby(zip(d, gone), lambda x: x[1]) if not cut]
        out.append("".join(p.decode("utf-8", "ignore") for p in parts))
    return out
