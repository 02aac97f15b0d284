"""Brute force for the operators of the llm subpackage."""

from __future__ import annotations

import re

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None) -> frozenset:
    words = re.findall(f"[^{SPACES}]+", (text or "").translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def components(texts: dict) -> dict:
    """id: (size of its set, least id reachable by links)."""
    sets, up = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = sorted((root(i), root(j)))
                up[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def edit_distance_within(item: str, text: str) -> int:
    """The least edit distance of item to any substring of text."""
    prev = list(range(len(item) + 1))
    best = prev[-1]
    for c in text:
        now = [0]
        for i, p in enumerate(item, 1):
            now.append(min(prev[i - 1] + (p != c), prev[i] + 1, now[i - 1] + 1))
        prev, best = now, min(best, now[-1])
    return best
