"""Plain versions of the operators, to compare with on small tables."""

from __future__ import annotations

import math

import re
from collections import defaultdict


def tokens(text: str | None) -> list[str]:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text: str | None, k: int = 5) -> frozenset:
    w = tokens(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def near_components(rows: list[tuple]) -> list[tuple]:
    """(doc_id, set size, smallest id reachable) of each (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    by_shingle = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by_shingle[x].append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in by_shingle[x] if j < i}:
            if 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                parent[root(i)] = root(j)
    least: dict[int, object] = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        if d is not None:
            least[r] = d if least.get(r) is None else min(least[r], d)
    return [(d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)]


def repeated_bytes(texts: list[str | None], length: int) -> list[tuple[int, int, int, bytes]]:
    """(bytes, removed bytes, removed runs, what is left) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = defaultdict(int)
    for b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] += 1
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return out


def ppm_bits(trained: list[str], text: str, order: int = 3) -> float:
    """Code length of a text (A-Z lowered) by escape method C with exclusion over all contexts of up to ``order`` bytes."""
    low = lambda t: bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode())
    counts: dict[bytes, dict[int, int]] = {}
    for t in trained:
        padded = b"\xff" * order + low(t)
        for i in range(order, len(padded)):
            for k in range(order + 1):
                own = counts.setdefault(padded[i - k : i], {})
                own[padded[i]] = own.get(padded[i], 0) + 1
    known: dict[bytes, list[float]] = {}

    def chances(context: bytes) -> list[float]:
        if context not in known:
            shorter = chances(context[1:]) if context else [1 / 256] * 256
            c = counts.get(context)
            if not c:
                known[context] = shorter
            else:
                n, unseen = sum(c.values()), sum(p for s, p in enumerate(shorter) if s not in c)
                known[context] = [c[s] / (n + len(c)) if s in c else len(c) / (n + len(c)) * shorter[s] / unseen for s in range(256)]
        return known[context]

    padded = b"\xff" * order + low(text)
    return -sum(math.log2(chances(padded[i - order : i])[padded[i]]) for i in range(order, len(padded)))
