"""Duplicate substrings by merging the Burrows-Wheeler transforms of shards.

Within a slot of ``repeats`` the pieces are cut into shards. Each shard sorts only its
own rotations. The merged order of all shards is an interleave: for every place, the
shard its next rotation comes from. It starts as shard after shard and is refined by
stable bucket passes over the transforms, four symbols a pass where their strings can be numbered
in 16 bits, else fewer; after h symbols it is the
order by the first h symbols, so no suffix of different shards is ever compared. The
pass at which a place first parts two neighbours is their common prefix; places that
never part within ``size`` symbols are intervals of a repeated string. Pieces none of
whose windows has the hash of a window of another document are not merged.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lorewell.llm.repeats import Units, removed_repeats, window_hashes

SIZE = 50
SHARD_BYTES = 32 * 1024
SYMBOLS = 4


def shard_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of a shard's rotations, ordered by at least their first ``depth`` symbols."""
    n = len(text)
    key = np.zeros(n, np.uint64)
    twice = np.concatenate([text, np.resize(text, 8)]).astype(np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | twice[j : j + n]
    known = 8
    while True:
        order = np.argsort(key)  # equal keys in any order
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, sorted_key[1:] != sorted_key[:-1]))
        if known >= depth or rank[order[-1]] == n - 1:
            return order
        key = ((rank << 32) | np.roll(rank, -(known % n))).astype(np.uint64)
        known *= 2


def _transform(shards: list[np.ndarray], orders: list[np.ndarray], width: int) -> np.ndarray:
    """For every rotation in order, the ``width`` symbols before it as one number; one shard after the other."""
    parts = []
    for s, o in zip(shards, orders):
        code = np.zeros(len(s), np.uint32)
        for back in range(width, 0, -1):
            code = (code << np.uint32(8)) | np.roll(s, back)
        parts.append(code[o])
    return np.concatenate(parts)


def merge_transforms(shards: list[np.ndarray], depth: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Interleave the rotations of all shards by their first ``depth`` symbols.

    Returns the merged order as places in the concatenated shards, and for every place
    the common prefix with the one before it, rounded down to the last pass
    (``depth``: at least that long).
    """
    orders = [shard_order(s, depth) for s in shards]
    width = SYMBOLS
    while True:
        codes, transform = np.unique(_transform(shards, orders, width), return_inverse=True)
        if len(codes) <= 65536:
            break
        width -= 1
    transform, last = transform.astype(np.uint16), depth % width
    n = len(transform)
    shard_type = np.uint8 if len(shards) <= 256 else np.uint16 if len(shards) <= 65536 else np.uint32
    interleave = np.repeat(np.arange(len(shards), dtype=shard_type), [len(s) for s in shards])
    common = np.full(n, depth, np.uint8)
    common[:1] = 0
    symbols, block, parted = np.empty(n, np.uint16), np.zeros(n, np.int32), np.ones(n, bool)
    for h in [*range(0, depth - last, width), *([depth - last] if last else [])]:
        if h + width > depth:
            transform = np.unique(_transform(shards, orders, last), return_inverse=True)[1].astype(np.uint16)
        symbols[np.argsort(interleave, kind="stable")] = transform
        step = np.argsort(symbols, kind="stable")
        moved, within = symbols[step], block[step]
        np.logical_or(moved[1:] != moved[:-1], within[1:] != within[:-1], out=parted[1:])
        common[parted & (common == depth)] = h
        np.cumsum(parted, out=block)
        interleave = interleave[step]
    bases = np.cumsum([0, *[len(s) for s in shards[:-1]]])
    merged = np.empty(n, np.int64)
    merged[np.argsort(interleave, kind="stable")] = np.concatenate([o + b for o, b in zip(orders, bases)])
    return merged, common


def _shards(contents: list[bytes]) -> list[np.ndarray]:
    shards, held, size = [], [], 0
    for c in contents:
        held.append(c)
        size += len(c)
        if size >= SHARD_BYTES:
            shards.append(np.frombuffer(b"".join(held), np.uint8))
            held, size = [], 0
    if held:
        shards.append(np.frombuffer(b"".join(held), np.uint8))
    return shards


def contested(contents: list[bytes], counts: np.ndarray, docs: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Which pieces hold a window whose hash other pieces of another document have too; no window of the rest can start earlier."""
    hashes = window_hashes(contents, size)
    owner = np.repeat(np.arange(len(contents)), counts)
    order = np.argsort(hashes)
    hashes, doc = hashes[order], docs[owner[order]]
    heads = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    apart = np.minimum.reduceat(doc, heads) != np.maximum.reduceat(doc, heads)
    held = np.zeros(len(contents), bool)
    held[owner[order[np.repeat(apart, np.diff(np.append(heads, len(doc))))]]] = True
    return held


def judge(contents: list[bytes], counts: np.ndarray, docs: np.ndarray, starts: np.ndarray, size: int = SIZE) -> np.ndarray:
    """For every window of the pieces in turn, whether it also starts in a document with a smaller id."""
    held = contested(contents, counts, docs, size)
    out = np.zeros(counts.sum(), bool)
    if held.any():
        out[np.repeat(held, counts)] = _merged_judge([c for c, h in zip(contents, held.tolist()) if h], counts[held], docs[held], size)
    return out


def _merged_judge(contents: list[bytes], counts: np.ndarray, docs: np.ndarray, size: int) -> np.ndarray:
    merged, common = merge_transforms(_shards(contents), size)
    lengths = np.array([len(c) for c in contents])
    begin = np.cumsum(lengths) - lengths
    windows = np.repeat(begin - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    doc = np.full(len(merged), np.iinfo(np.int64).max)  # what runs over a piece's end is no window
    doc[windows] = np.repeat(docs, counts)
    doc = doc[merged]
    heads = np.flatnonzero(common < size)
    least = np.repeat(np.minimum.reduceat(doc, heads), np.diff(np.append(heads, len(doc))))
    earlier = np.empty(len(doc), bool)
    earlier[merged] = least < doc
    return earlier[windows]


def spans_of(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _digest(text: bytes, gone: np.ndarray) -> tuple:
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return len(text), int(gone.sum()), len(spans_of(gone)), hashlib.sha256(kept).hexdigest()


def _cleaned(text: bytes, gone: np.ndarray) -> tuple:
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), [{"begin": a, "end": b} for a, b in spans_of(gone)]


def remove_substrings(docs: DataFrame, digest: bool = False, size: int = SIZE) -> DataFrame:
    """Remove from ``docs(doc_id, text)`` every byte of a ``size``-byte string that also starts in a document with a smaller id.

    One row per row: ``doc_id, kept`` (bytes) and ``spans`` (removed byte ranges), or with
    ``digest`` ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``. Strings are judged on
    the input. A null text is empty; a text shorter than ``size`` is kept; a row with a
    null ``doc_id`` is neither compared nor changed; rows that share a ``doc_id`` are
    one document, which never removes from itself. Other columns are ignored; an empty
    table gives no rows. ``size`` is from 16 to 64.
    """
    if not 16 <= size <= 64:
        raise ValueError("size must be from 16 to 64")
    kind = Units(size=size, gram=16 if size >= 32 else 8, words=False, across=True)
    judged = partial(judge, size=size)
    if digest:
        return removed_repeats(docs, kind, judged, _digest, ["n_bytes", "n_removed", "n_spans", "kept_sha256"],
                               [pa.int64(), pa.int64(), pa.int64(), pa.string()], "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    return removed_repeats(docs, kind, judged, _cleaned, ["kept", "spans"], [pa.binary(), span],
                           "doc_id long, kept binary, spans array<struct<begin: long, end: long>>")
