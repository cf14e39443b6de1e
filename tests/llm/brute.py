"""Plain reference versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def substrings(docs: list[tuple[int, bytes]], size: int = 50) -> dict[int, tuple]:
    first: dict[bytes, int] = {}
    for i, t in docs:
        for a in range(len(t) - size + 1):
            first[t[a : a + size]] = min(i, first.get(t[a : a + size], i))
    out = {}
    for i, t in docs:
        gone = [False] * len(t)
        for a in range(len(t) - size + 1):
            if first[t[a : a + size]] < i:
                gone[a : a + size] = [True] * size
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(t), sum(gone), spans, sha(bytes(b for b, g in zip(t, gone) if not g)))
    return out


def sequences(docs: list[tuple[int, bytes]], size: int = 20) -> dict[int, tuple]:
    words = {i: re.findall(rb"[^\x20\x09-\x0D]+", t) for i, t in docs}
    first: dict[tuple, tuple] = {}
    for i, w in words.items():
        for a in range(len(w) - size + 1):
            key = tuple(w[a : a + size])
            first[key] = min((i, a), first.get(key, (i, a)))
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for a in range(len(w) - size + 1):
            if first[tuple(w[a : a + size])] < (i, a):
                gone[a : a + size] = [True] * size
        out[i] = (len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def near_groups(docs: list[tuple[int, str]], percent: int) -> dict[int, tuple]:
    """doc_id: (set size, smallest id of the component), by all pairs that share a shingle."""
    sets: dict[int, frozenset] = {}
    for i, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        sets[i] = frozenset(tuple(words[a : a + 5]) for a in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])
    by: dict[tuple, list[int]] = {}
    for i, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(i)
    root = {i: i for i in sets}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    seen = set()
    for group in by.values():
        for x in group:
            for y in group:
                if x < y and (x, y) not in seen:
                    seen.add((x, y))
                    both = len(sets[x] & sets[y])
                    if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                        a, b = sorted((find(x), find(y)))
                        root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}
