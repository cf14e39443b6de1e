"""Byte-pair merging of one pre-token, shared by the counting and the encoding operator."""

from __future__ import annotations

from collections.abc import Callable
from heapq import heapify, heappop, heappush

# A worker's cache of pre-tokens is emptied when it holds this many entries; a later miss is merged anew.
CACHE_ENTRIES = 400_000


def merge_symbols(symbols: list[str], rank: Callable[[str, str], float | None]) -> list[str]:
    """Merge neighbours in order of rank (smallest first, leftmost among equals).

    The symbols form a doubly linked list over fixed places. Every possible merge
    waits in a heap with the string it would give; an entry whose place has since
    changed gives another string and is skipped as stale.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    held: list[str | None] = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = [(r, i, held[i] + held[i + 1]) for i in range(n - 1) if (r := rank(held[i], held[i + 1])) is not None]
    heapify(queue)
    while queue:
        _, i, whole = heappop(queue)
        left = held[i]
        j = after[i]
        if left is None or j == n or len(left) + len(held[j]) != len(whole):
            continue
        held[i], held[j] = whole, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := rank(whole, held[k])) is not None:
                heappush(queue, (r, i, whole + held[k]))
        h = before[i]
        if h >= 0 and (r := rank(held[h], whole)) is not None:
            heappush(queue, (r, h, held[h] + whole))
    return [s for s in held if s is not None]


class Cache(dict):
    """Memo of a function of one string; bounded by emptying it."""

    def __init__(self, make: Callable, fixed: dict | None = None, entries: int | None = None):
        super().__init__(fixed or {})
        self.make, self.fixed, self.entries = make, fixed or {}, entries

    def __missing__(self, key):
        if len(self) >= (self.entries or CACHE_ENTRIES) + len(self.fixed):
            self.clear()
            self.update(self.fixed)
        self[key] = value = self.make(key)
        return value
