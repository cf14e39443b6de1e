"""Repeated word sequences by suffix trees over prefix-partitioned suffixes.

Within a slot of ``repeats`` every window start is a suffix. Suffixes are split by
prefixes of variable length: neighbouring prefixes with few suffixes share a group, a
prefix with more suffixes than a group holds is lengthened by a word, until the group
fits or the prefix is a whole window. The subtree of a group follows from its sorted
suffixes and their common prefixes; an internal node at the depth of a window holds all
places of one repeated sequence. Trees are cut at that depth, as deeper nodes tell
nothing more about windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lorewell.llm.bwt_merge import spans_of
from lorewell.llm.repeats import Units, removed_repeats

SIZE = 20
GROUP = 32_768  # suffixes in memory as one group


def prefix_groups(codes: np.ndarray, suffixes: np.ndarray, size: int, depth: int = 0, group: int = GROUP) -> Iterator[tuple[int, np.ndarray]]:
    """Groups of suffixes with the length of the prefix that all of a group share."""
    if len(suffixes) <= group or depth == size:
        yield depth, suffixes
        return
    words = codes[suffixes + depth]
    order = np.argsort(words, kind="stable")
    suffixes, words = suffixes[order], words[order]
    heads = np.append(np.flatnonzero(np.append(True, words[1:] != words[:-1])), len(words))
    begin = 0
    for a, b in zip(heads[:-1], heads[1:]):
        if b - a > group:
            if a > begin:
                yield depth, suffixes[begin:a]
            yield from prefix_groups(codes, suffixes[a:b], size, depth + 1, group)
            begin = b
        elif b - begin > group:
            yield depth, suffixes[begin:a]
            begin = a
    if begin < len(suffixes):
        yield depth, suffixes[begin:]


def deep_nodes(codes: np.ndarray, suffixes: np.ndarray, size: int, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in tree order, and the places where a new node of depth ``size`` begins."""
    if shared == size:
        return suffixes, np.zeros(1, np.int64)
    paths = codes[suffixes[:, None] + np.arange(shared, size)]
    order = np.lexsort(paths.T[::-1])
    paths = paths[order]
    common = np.where((differ := paths[1:] != paths[:-1]).any(axis=1), differ.argmax(axis=1), size - shared) + shared
    return suffixes[order], np.append(0, np.flatnonzero(common < size) + 1)


def judge(contents: list[bytes], counts: np.ndarray, docs: np.ndarray, starts: np.ndarray, size: int = SIZE, group: int = GROUP) -> np.ndarray:
    """For every window of the pieces in turn, whether it also starts at an earlier place."""
    vocabulary: dict[bytes, int] = {}
    codes = np.array([vocabulary.setdefault(w, len(vocabulary)) for c in contents for w in c.split()], np.int32)
    lengths = counts + size - 1
    begin = np.cumsum(lengths) - lengths
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    suffixes = np.repeat(begin, counts) + offset
    doc = np.repeat(docs, counts)
    start = np.repeat(starts, counts) + offset
    order = np.lexsort((start, doc))
    fresh = np.append(0, (doc[order][1:] != doc[order][:-1]) | (start[order][1:] != start[order][:-1]))
    place = np.zeros(len(codes), np.int64)
    place[suffixes[order]] = np.cumsum(fresh)  # equal for rows that share id and start
    earlier = np.zeros(len(codes), bool)
    for shared, members in prefix_groups(codes, suffixes, size, 0, group):
        ordered, heads = deep_nodes(codes, members, size, shared)
        at = place[ordered]
        least = np.repeat(np.minimum.reduceat(at, heads), np.diff(np.append(heads, len(at))))
        earlier[ordered] = least < at
    return earlier[suffixes]


def _digest(text: bytes, gone: np.ndarray) -> tuple:
    return len(gone), int(gone.sum()), hashlib.sha256(b" ".join(compress(text.split(), ~gone))).hexdigest()


def _cleaned(text: bytes, gone: np.ndarray) -> tuple:
    return b" ".join(compress(text.split(), ~gone)), [{"begin": a, "end": b} for a, b in spans_of(gone)]


def remove_sequences(docs: DataFrame, digest: bool = False, size: int = SIZE) -> DataFrame:
    """Remove from ``docs(doc_id, text)`` every word of a ``size``-word window that also starts earlier.

    Earlier means a smaller ``doc_id``, or the same document and an earlier word. One row
    per row: ``doc_id, kept`` (bytes, words joined by a space) and ``spans`` (removed
    word ranges), or with ``digest`` ``doc_id, n_words, n_removed, kept_sha256``. Windows
    are judged on the input. A null text has no words; a text of fewer words is kept; a
    row with a null ``doc_id`` is neither compared nor changed; rows that share a
    ``doc_id`` are compared by their word places, and equal places do not remove each
    other. Other columns are ignored; an empty table gives no rows.
    """
    kind = Units(size=size, gram=max(1, min(8, size // 2)), words=True, across=False)
    judged = partial(judge, size=size)
    if digest:
        return removed_repeats(docs, kind, judged, _digest, ["n_words", "n_removed", "kept_sha256"],
                               [pa.int64(), pa.int64(), pa.string()], "doc_id long, n_words long, n_removed long, kept_sha256 string")
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    return removed_repeats(docs, kind, judged, _cleaned, ["kept", "spans"], [pa.binary(), span],
                           "doc_id long, kept binary, spans array<struct<begin: long, end: long>>")
