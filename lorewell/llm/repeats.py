"""Shared plumbing of the two substring operators: which windows of a corpus were seen before.

A *unit* is a byte or a word, a *window* is ``size`` consecutive units of one row.
The job is one lazy plan over ``blocks`` (hash groups of texts of a few MB):

1. census: every window is represented by its *anchor*, the smallest hash among its
   grams of ``gram`` units. Equal windows have equal anchors. Each block reports its
   distinct anchors, cut by value into buckets;
2. flags: a bucket tells each block which of its anchors occur elsewhere too. A window
   whose anchor occurs once in the corpus cannot be repeated and is settled here;
3. pieces: runs of remaining windows with one anchor become pieces of text, one row per
   distinct piece and block, and go to the slot of their anchor. An anchor with very many
   pieces is split: its windows travel alone, keyed by their full content;
4. judge (the operator's own method): per slot, which windows of a piece start earlier;
5. final: each block turns the answers into removed units and hashes the rest.

Blocks are dealt by text, so copies of a whole text meet in a block and only the first is
compared. The text is shuffled once; Spark reuses that exchange for steps 1, 3 and 5. Hash
collisions only let more windows pass to step 4, which compares content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm.common import partitions

SLICE_BYTES = 256 * 1024  # bytes worked on at once, so that the arrays stay in the processor's cache
BLOCKS_PER_PARTITION = 4
CROWDED = 64_000  # pieces of one anchor above which its windows are dealt by their full content
ANCHOR_BYTES = 6
CHUNK_BYTES = 512 * 1024  # pieces judged at once, cut between anchors

CENSUS = "bucket int, block int, anchors binary, counts binary"
FLAGS = "block int, bucket int, repeated binary, crowded binary"
PIECES = "hash int, content binary, n int, block int, row int, start int, doc_id long, later binary"
MARKS = "block int, row int, start int, n int, bits binary, later binary"

# distinct pieces, their numbers of windows, first documents and first units -> for every window in turn, whether it starts earlier
Judge = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], np.ndarray]

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE_HASH = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(a: np.ndarray) -> np.ndarray:
    a ^= a >> np.uint64(29)
    a *= _M2
    a ^= a >> np.uint64(32)
    return a


def gram_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive units, by doubling."""
    if k == 1:
        return units
    half = gram_hashes(units, k // 2)
    n = len(units) - 2 * (k // 2) + 1
    both = half[:n] * _M1
    both += half[k // 2 : k // 2 + n]
    _mix(both)
    if k % 2:
        both = _mix(both[: n - 1] * _M1 + units[k - 1 : k - 1 + n - 1])
    return both


def window_hashes(contents: list[bytes], size: int) -> np.ndarray:
    """Hashes of the ``size``-byte windows of the pieces in turn; every piece has at least that length."""
    counts = np.array([len(c) for c in contents]) - size + 1
    every = gram_hashes(_BYTE_HASH[np.frombuffer(b"".join(contents), np.uint8)], size)
    # windows that run over a piece's end are left out
    return every[np.arange(counts.sum()) + np.repeat(np.arange(len(contents)) * (size - 1), counts)]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


@dataclass(frozen=True)
class Units:
    """How texts fall into units and windows; ``across`` compares documents only."""

    size: int
    gram: int
    words: bool
    across: bool

    def spans(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte offsets at which words start and end."""
        inside = np.empty(len(buf) + 2, bool)
        inside[0] = inside[-1] = False
        np.logical_not(_SPACE[buf], out=inside[1:-1])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        return edges[::2], edges[1::2]

    def hashes(self, buf: np.ndarray, starts: np.ndarray | None, ends: np.ndarray | None) -> np.ndarray:
        codes = _BYTE_HASH[buf]
        if not self.words:
            return codes
        # weights by place in the word; a sum of mixed products is enough to tell words apart
        word = np.zeros(len(buf), np.int64)
        word[starts] = 1
        np.cumsum(word, out=word)
        place = (np.arange(len(buf)) - np.append(0, starts)[word]).astype(np.uint64)
        codes = codes * (_M1 * (np.uint64(2) * place + np.uint64(1)))
        codes ^= codes >> np.uint64(31)
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(codes, out=total[1:])
        return _mix(total[ends] - total[starts])


@dataclass
class Slice:
    """Consecutive units of some rows, with the windows that lie inside and their anchors."""

    buf: np.ndarray
    starts: np.ndarray | None
    ends: np.ndarray | None
    row: np.ndarray  # of each piece
    start: np.ndarray  # first window of each piece, as unit of its row
    count: np.ndarray  # windows of each piece
    anchor: np.ndarray
    first: np.ndarray  # first window of each piece, as unit of the slice
    multiple: np.ndarray  # the anchor occurs at several places of the piece


def _slice(kind: Units, buf: np.ndarray, rows: np.ndarray, offsets: np.ndarray, base: int) -> Slice | None:
    """``offsets``: byte at which each of ``rows`` starts; ``base``: unit of the (single) row at which a chunk starts."""
    starts = ends = None
    if kind.words:
        starts, ends = kind.spans(buf)
        owner = np.searchsorted(offsets, starts, "right") - 1
        begun = np.searchsorted(starts, offsets, "left")
        n = len(starts)
    else:
        n = len(buf)
        owner = np.repeat(np.arange(len(rows)), np.diff(np.append(offsets, n)))
        begun = offsets
    windows = n - kind.size + 1
    if windows <= 0:
        return None
    valid = owner[:windows] == owner[kind.size - 1 :]
    if not valid.any():
        return None
    grams = gram_hashes(kind.hashes(buf, starts, ends), kind.gram)
    anchors = sliding_min(grams, kind.size - kind.gram + 1)
    fresh = np.empty(windows, bool)
    fresh[0] = True
    np.not_equal(anchors[1:], anchors[:-1], out=fresh[1:])
    fresh[1:] |= ~valid[:-1]
    first = np.flatnonzero(fresh & valid)
    stop = np.flatnonzero(np.append(fresh[1:] | ~valid[1:], True) & valid) + 1
    count = stop - first
    anchor = anchors[first]
    multiple = np.zeros(len(first), bool)
    if not kind.across:  # repeats inside a piece need its anchor at two places
        span = count + (kind.size - kind.gram)
        at = np.repeat(first - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum())
        multiple = np.add.reduceat((grams[at] == np.repeat(anchor, span)).astype(np.int64), np.cumsum(span) - span) > 1
    which = owner[first]
    # minima crowd near zero; mixed again they fall evenly into buckets and slots
    anchor = _mix(anchor)
    return Slice(buf, starts, ends, rows[which], first - begun[which] + base, count, anchor, first, multiple)


def slices(kind: Units, texts: list[bytes], rows: list[int]) -> Iterator[Slice]:
    """Cut rows into slices of bounded size; long rows overlap by one window less a unit."""
    held: list[int] = []
    size = 0

    def flush() -> Slice | None:
        gap = 1 if kind.words else 0
        lengths = np.array([len(texts[r]) + gap for r in held])
        joined = (b"\n" if gap else b"").join(texts[r] for r in held)
        return _slice(kind, np.frombuffer(joined, np.uint8), np.array(held), np.cumsum(lengths) - lengths, 0)

    for r in rows:
        if len(texts[r]) > SLICE_BYTES:
            yield from _long(kind, texts[r], r)
            continue
        if held and size + len(texts[r]) > SLICE_BYTES:
            if part := flush():
                yield part
            held, size = [], 0
        held.append(r)
        size += len(texts[r])
    if held and (part := flush()):
        yield part


def _long(kind: Units, text: bytes, row: int) -> Iterator[Slice]:
    buf, one, zero = np.frombuffer(text, np.uint8), np.array([row]), np.zeros(1, np.int64)
    starts, ends = kind.spans(buf) if kind.words else (None, None)
    n = len(starts) if kind.words else len(buf)
    step = SLICE_BYTES // (6 if kind.words else 1)
    for a in range(0, n, step):
        b = min(n, a + step + kind.size - 1)
        part = buf[starts[a] : ends[b - 1]] if kind.words else buf[a:b]
        if found := _slice(kind, part, one, zero, a):
            yield found


def _rows(table: pa.Table) -> tuple[list[int | None], list[bytes]]:
    """Rows of a block in one order whatever order they arrived in."""
    pairs = sorted(zip(table.column("doc_id").to_pylist(), (t or b"" for t in table.column("text").to_pylist())), key=lambda p: (p[0] is None, p[0] or 0, p[1]))
    return [p[0] for p in pairs], [p[1] for p in pairs]


def _firsts(ids: list[int | None], texts: list[bytes]) -> tuple[list[int], dict[int, int]]:
    """Rows to compare, and for each copy of a whole text in the block the row that has it first. Rows without id are neither."""
    seen: dict[bytes, int] = {}
    rows, copies = [], {}
    for r, i in enumerate(ids):
        if i is not None:
            first = seen.setdefault(texts[r], r)
            if first == r:
                rows.append(r)
            else:
                copies[r] = first
    return rows, copies


def _cut(anchors: np.ndarray) -> np.ndarray:
    return anchors >> np.uint64(64 - 8 * ANCHOR_BYTES)


def block_anchors(kind: Units, ids: list[int | None], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchors of a block, ascending, and their number of documents or places."""
    seen, by = [], []
    for part in slices(kind, texts, _firsts(ids, texts)[0]):
        anchor = _cut(part.anchor)
        if kind.across:  # once per document
            doc = np.array([ids[r] for r in part.row], np.int64)
            order = np.lexsort((doc, anchor))
            anchor, doc = anchor[order], doc[order]
            keep = np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))
            anchor, doc = anchor[keep], doc[keep]
            by.append(doc)
        else:
            anchor = np.concatenate([anchor, anchor[part.multiple]])
        seen.append(anchor)
    if not seen:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    every = np.concatenate(seen)
    if kind.across:
        docs = np.concatenate(by)
        order = np.lexsort((docs, every))
        every, docs = every[order], docs[order]
        every = every[np.append(True, (every[1:] != every[:-1]) | (docs[1:] != docs[:-1]))]
    return np.unique(every, return_counts=True)


def _bucket_edges(anchors: np.ndarray, buckets: int) -> np.ndarray:
    span = (1 << (8 * ANCHOR_BYTES)) // buckets + 1
    return np.searchsorted(anchors, np.arange(buckets + 1, dtype=np.uint64) * np.uint64(span))


def census_of(kind: Units, buckets: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def census(key: tuple, table: pa.Table) -> pa.Table:
        anchors, counts = block_anchors(kind, *_rows(table))
        edges = _bucket_edges(anchors, buckets)
        low = anchors.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :ANCHOR_BYTES]
        counts = np.minimum(counts, 65535).astype("<u2")
        used = [b for b in range(buckets) if edges[b] < edges[b + 1]]
        return pa.table({
            "bucket": pa.array(used, pa.int32()), "block": pa.array([key[0].as_py()] * len(used), pa.int32()),
            "anchors": pa.array([low[edges[b] : edges[b + 1]].tobytes() for b in used], pa.binary()),
            "counts": pa.array([counts[edges[b] : edges[b + 1]].tobytes() for b in used], pa.binary()),
        })

    return census


def flag_bucket(key: tuple, table: pa.Table) -> pa.Table:
    """Which anchors of each block occur twice or more in all blocks together, and which are crowded."""
    blocks = table.column("block").to_pylist()
    blobs = [np.frombuffer(b, np.uint8).reshape(-1, ANCHOR_BYTES) for b in table.column("anchors").to_pylist()]
    lengths = [len(b) for b in blobs]
    wide = np.zeros((sum(lengths), 8), np.uint8)
    wide[:, :ANCHOR_BYTES] = np.concatenate(blobs)
    anchors = wide.view("<u8").ravel()
    counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), "<u2").astype(np.int64)
    order = np.argsort(anchors, kind="stable")
    ordered = anchors[order]
    heads = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    totals = np.repeat(np.add.reduceat(counts[order], heads), np.diff(np.append(heads, len(ordered))))
    total = np.empty(len(anchors), np.int64)
    total[order] = totals
    cuts = np.cumsum([0, *lengths])
    bits = lambda mask: [np.packbits(mask[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
    return pa.table({
        "block": pa.array(blocks, pa.int32()), "bucket": pa.array([key[0].as_py()] * len(blocks), pa.int32()),
        "repeated": pa.array(bits(total > 1), pa.binary()), "crowded": pa.array(bits(total > CROWDED), pa.binary()),
    })


def pieces_of(kind: Units, buckets: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def pieces(key: tuple, table: pa.Table, flags: pa.Table) -> pa.Table:
        out: dict[bytes, list] = {}
        ids, texts = _rows(table)
        anchors, _ = block_anchors(kind, ids, texts)
        edges = _bucket_edges(anchors, buckets)
        repeated, crowded = np.zeros(len(anchors), bool), np.zeros(len(anchors), bool)
        for b, r, c in zip(*(flags.column(n).to_pylist() for n in ("bucket", "repeated", "crowded"))):
            a, z = edges[b], edges[b + 1]
            repeated[a:z] = np.unpackbits(np.frombuffer(r, np.uint8), count=z - a)
            crowded[a:z] = np.unpackbits(np.frombuffer(c, np.uint8), count=z - a)
        for part in slices(kind, texts, _firsts(ids, texts)[0]) if repeated.any() else ():
            at = np.searchsorted(anchors, _cut(part.anchor))
            use = np.flatnonzero(repeated[at])
            raw = part.buf.tobytes()
            fine = (part.anchor[use] >> np.uint64(33)).tolist()
            for h, split, n, first, row, start in zip(fine, crowded[at[use]].tolist(), *(c[use].tolist() for c in (part.count, part.first, part.row, part.start))):
                for j, m in [(j, 1) for j in range(n)] if split else [(0, n)]:
                    last = first + j + m + kind.size - 2
                    if kind.words:
                        content = b" ".join(raw[part.starts[first + j] : part.ends[last]].split())  # cuts at the contracts' six characters
                    else:
                        content = raw[first + j : last + 1]
                    place = (ids[row], start + j, row)
                    held = out.get(content)
                    if held is None:
                        out[content] = [_hash(content) if split else h, m, place, []]
                    elif kind.across or place >= held[2]:
                        held[3].append(place)
                    else:  # rows that share an id come in any order of places
                        held[3].append(held[2])
                        held[2] = place
        block = key[0].as_py()
        rows = [(h, content, m, block, p[2], p[1], p[0], _later(kind, p, rest) if rest else b"") for content, (h, m, p, rest) in out.items()]
        columns = list(zip(*rows)) if rows else [()] * 8
        kinds = [pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        names = ["hash", "content", "n", "block", "row", "start", "doc_id", "later"]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return pieces


def _hash(content: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(content, digest_size=4).digest(), "little") >> 1


def _later(kind: Units, first: tuple, rest: list[tuple]) -> bytes:
    """Further places of a piece in its block: row, start, and whether it comes later (or ties)."""
    key = (lambda p: p[0]) if kind.across else (lambda p: p[:2])
    return np.array([(p[2], p[1], int(key(p) > key(first))) for p in rest], "<i4").tobytes()


def judged_of(kind: Units, judge: Judge) -> Callable[[pa.Table], pa.Table]:
    """Answers of a slot: ``bits`` null for no window, empty for all windows, else one bit a window."""

    def judged(table: pa.Table) -> pa.Table:
        contents = table.column("content").to_pylist()
        n, docs, starts, hashes = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "doc_id", "start", "hash"))
        index: dict[bytes, int] = {}
        which = np.fromiter((index.setdefault(c, len(index)) for c in contents), np.int64, len(contents))
        order = np.lexsort((starts, docs, which))
        head = order[np.flatnonzero(np.append(True, which[order][1:] != which[order][:-1]))]  # first place of each distinct piece
        behind = docs > docs[head][which] if kind.across else (docs > docs[head][which]) | ((docs == docs[head][which]) & (starts > starts[head][which]))
        distinct = list(index)
        some, every, bits = np.zeros(len(head), bool), np.zeros(len(head), bool), [None] * len(head)
        for chunk in _chunks(hashes[head], [len(c) for c in distinct]):
            own = head[chunk]
            flat = judge([distinct[i] for i in chunk], n[own], docs[own], starts[own])
            begin = np.cumsum(n[own]) - n[own]
            hits = np.add.reduceat(flat.astype(np.int64), begin)
            some[chunk], every[chunk] = hits > 0, hits == n[own]
            for i, b, m in zip(chunk[(hits > 0) & (hits < n[own])].tolist(), begin[(hits > 0) & (hits < n[own])].tolist(), n[own][(hits > 0) & (hits < n[own])].tolist()):
                bits[i] = np.packbits(flat[b : b + m]).tobytes()
        later = table.column("later").to_pylist()
        use = [i for i, (w, b) in enumerate(zip(which.tolist(), behind.tolist())) if b or some[w] or later[i]]
        answers = [b"" if behind[i] or every[which[i]] else bits[which[i]] for i in use]
        kept = table.select(["block", "row", "start", "n"]).take(pa.array(use, pa.int64()))
        return kept.append_column("bits", pa.array(answers, pa.binary())).append_column("later", pa.array([later[i] for i in use], pa.binary()))

    return judged


def _chunks(hashes: np.ndarray, sizes: list[int]) -> Iterator[np.ndarray]:
    """Groups of pieces of about ``CHUNK_BYTES``; pieces with one hash stay together."""
    order = np.argsort(hashes, kind="stable")
    total = np.cumsum(np.array(sizes)[order])
    heads = np.flatnonzero(np.append(True, hashes[order][1:] != hashes[order][:-1]))
    chunk = np.append(0, total)[heads] // CHUNK_BYTES  # of each anchor, by where its pieces begin
    yield from np.split(order, heads[1:][chunk[1:] != chunk[:-1]])


def covered(kind: Units, n: int, marks: list[tuple[int, int, np.ndarray | None]]) -> np.ndarray:
    """Units that lie in a removed window; marks: start, number of windows, which of them (None: all)."""
    edge = np.zeros(n + 1, np.int64)
    for start, count, mask in marks:
        if mask is None:
            edge[start] += 1
            edge[start + count + kind.size - 1] -= 1
        else:
            at = np.flatnonzero(mask) + start
            np.add.at(edge, at, 1)
            np.add.at(edge, at + kind.size, -1)
    return np.cumsum(edge[:-1]) > 0


def final_of(kind: Units, finish: Callable[[bytes, np.ndarray], tuple], names: list[str], kinds: list[pa.DataType]):
    """``finish`` gives the result columns of a row from its text and the mask of its removed units."""

    def final(key: tuple, table: pa.Table, marks: pa.Table) -> pa.Table:
        ids, texts = _rows(table)
        by: dict[int, list] = {}
        for row, start, n, bits, later in zip(*(marks.column(c).to_pylist() for c in ("row", "start", "n", "bits", "later"))):
            mask = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool) if bits else None
            if bits is not None:
                by.setdefault(row, []).append((start, n, mask))
            if later:
                for r, s, after in np.frombuffer(later, "<i4").reshape(-1, 3).tolist():
                    if after:
                        by.setdefault(r, []).append((s, n, None))
                    elif bits is not None:
                        by.setdefault(r, []).append((s, n, mask))
        rows = []
        copies = _firsts(ids, texts)[1]
        for r, text in enumerate(texts):
            size = len(text.split()) if kind.words else len(text)
            if r in copies:
                first = copies[r]
                by[r] = by.get(first, []) if ids[r] == ids[first] else [(0, size - kind.size + 1, None)] if size >= kind.size else []
            rows.append((ids[r], *finish(text, covered(kind, size, by.get(r, [])))))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64(), *kinds])], names=["doc_id", *names])

    return final


def removed_repeats(docs: DataFrame, kind: Units, judge: Judge, finish, names: list[str], kinds: list[pa.DataType], schema: str) -> DataFrame:
    """The plan of the module's head; ``judge`` gets distinct pieces with their first places and tells which of all their windows start earlier."""
    width = partitions(docs.sparkSession)
    blocks = BLOCKS_PER_PARTITION * width
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    digest = F.xxhash64("text")
    # a text with more than its share of rows is dealt by document; there are at most ``blocks`` such texts
    counts = source.groupBy(digest.alias("digest")).count()
    total = source.count()
    common = [r["digest"] for r in counts.where(F.col("count") * blocks > total).select("digest").collect()]
    deal = F.xxhash64(digest, F.when(digest.isin(common), F.col("doc_id"))) if common else digest
    texts = source.withColumn("block", F.pmod(deal, F.lit(blocks)).cast("int")).repartition(width, "block")

    flags = texts.groupBy("block").applyInArrow(census_of(kind, width), CENSUS).groupBy("bucket").applyInArrow(flag_bucket, FLAGS)
    pieces = texts.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(pieces_of(kind, width), PIECES)
    slots = pieces.withColumn("slot", F.pmod("hash", F.lit(blocks)))
    marks = slots.groupBy("slot").applyInArrow(judged_of(kind, judge), MARKS)
    return texts.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(final_of(kind, finish, names, kinds), schema)
