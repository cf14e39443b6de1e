"""Language-model scores from a weighted backoff automaton.

Tokens are the lower-cased (A-Z) words of a text and one end. The model is an n-gram model with
pseudo-count smoothing,

    P(w | h) = (c(h w) + M * P(w | h')) / (c(h) + M),    P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)),

where h' is h without its first word. As an automaton every seen history is a state, every seen
n-gram an arc with its whole log-probability, and every state has a failure arc to h' that
weighs log M / (c(h) + M). Every word leaves the empty state, so a traversal never stops.

The model grows with the corpus and is in no place whole. Texts lie in blocks of a few MB:

1. census: each block reports its distinct words and word pairs (hashes) with their counts in the
   training fold, cut by hash into buckets, so a frequent one is one number per block;
2. totals: a bucket adds the counts and tells each block which of its own n-grams occur in other
   blocks too, and how often in all;
3. longer n-grams follow order by order. One of which a part occurs in no other block cannot occur
   there either, so its count in the block is its total and it does not travel;
4. traversal: a block builds the part of the automaton that its texts can reach and walks all
   texts from left to right, many at once, carrying a state for each. Long texts are cut; a later
   part first walks the words before it, after which the state is that of the whole walk.

N, V and the size that decides the number of blocks come from one pass before. Texts are shuffled
once, compressed; Spark reuses that exchange for every step.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.llm.common import partitions
from lorewell.llm.repeats import _M1, Units, _mix

ORDER = 3
PSEUDO = 300.0  # M: weight of the shorter history, in observations
BLOCK_BYTES = 4 * 1024 * 1024
BUCKET_BYTES = 16 * 1024 * 1024
SLICE_BYTES = 256 * 1024  # text hashed at once
SEGMENT = 256  # tokens walked by one lane of a traversal
MERGED = 1_000_000  # distinct words that a task adds up before it passes them on

CENSUS = "bucket int, block int, size int, first long, width int, grams binary, counts binary"
TOTALS = "block int, bucket int, size int, common binary, totals binary"
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

END, BEGIN = np.uint64(0x5AFE0001D15EA5E1), np.uint64(0x5AFE0002D15EA5E3)
_WORDS = Units(size=1, gram=1, words=True, across=False)
_SEPARATOR = re.compile(rb"[\x20\x09-\x0D]")


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that the model does not learn from; a null id is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _parts(text: bytes) -> Iterator[bytes]:
    """A text in parts of bounded size, cut at separators."""
    at = 0
    while len(text) - at > SLICE_BYTES:
        cut = _SEPARATOR.search(text, at + SLICE_BYTES)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text."""
    counts, found = np.zeros(len(texts), np.int64), []
    held: list[tuple[int, bytes]] = []

    def flush() -> None:
        buf = np.frombuffer(b"\n".join(p for _, p in held), np.uint8)
        starts, ends = _WORDS.spans(buf)
        lengths = np.array([len(p) + 1 for _, p in held])
        owner = np.searchsorted(np.cumsum(lengths) - lengths, starts, "right") - 1
        np.add.at(counts, [d for d, _ in held], np.bincount(owner, minlength=len(held)))
        if len(starts):
            found.append(_WORDS.hashes(buf, starts, ends))
        held.clear()

    size = 0
    for d, text in enumerate(texts):
        for part in _parts(text.lower()):  # bytes: A-Z only
            if held and size + len(part) > SLICE_BYTES:
                flush()
                size = 0
            held.append((d, part))
            size += len(part)
    if held:
        flush()
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), counts


def _bits(size: int) -> int:
    """Bits of the hash of an n-gram: a false match of longer ones at 1e13 of them is one in 7000."""
    return 64 if size == 1 else 56


@dataclass
class Grams:
    """The n-grams of a block: tokens in one row of arrays, and the distinct ones of each length, ascending."""

    length: np.ndarray  # tokens of each text, the end included
    distinct: list[np.ndarray]
    trained: list[np.ndarray]  # occurrences of each distinct one in training texts
    last: list[np.ndarray]  # a token at which each distinct one ends
    at: list[np.ndarray]  # place among the distinct ones of the n-gram that ends at each token, or -1

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.length) - self.length


def grams(texts: list[bytes], learn: np.ndarray, order: int, least: int = 1) -> Grams:
    """N-grams of ``least`` to ``order`` tokens; the lists have empty places for shorter ones."""
    words, n_words = word_hashes(texts)
    length = n_words + 1
    token = np.full(int(length.sum()), END, np.uint64)
    starts = np.cumsum(length) - length
    place = np.arange(len(token)) - np.repeat(starts, length)
    token[place < np.repeat(n_words, length)] = words
    use = np.repeat(learn, length)
    own = Grams(length, [], [], [], [])
    whole = token
    for n in range(1, order + 1):
        if n > 1:
            before = np.append(BEGIN, whole[:-1])
            before[starts] = BEGIN
            whole = _mix(before * _M1 + token + np.uint64(n))
        valid = np.flatnonzero(place >= n - 2) if n > 2 else np.arange(len(token))
        at = np.full(len(token), -1, np.int64)
        distinct, last, trained = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if n >= least and len(valid):
            distinct, first, at[valid] = np.unique(whole[valid] >> np.uint64(64 - _bits(n)), return_index=True, return_inverse=True)
            last, trained = valid[first], np.bincount(at[valid], weights=use[valid], minlength=len(distinct)).astype(np.int64)
        for column, value in zip((own.distinct, own.trained, own.last, own.at), (distinct, trained, last, at)):
            column.append(value)
    return own


def pack_sorted(values: np.ndarray) -> tuple[int, int, bytes]:
    """Ascending hashes as the first one and steps of as few bytes as the largest needs."""
    steps = np.diff(values)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return int(values[:1].view(np.int64)[0]), width, steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_sorted(first: int, width: int, blob: bytes) -> np.ndarray:
    low = np.frombuffer(blob, np.uint8).reshape(-1, width)
    wide = np.zeros((len(low) + 1, 8), np.uint8)
    wide[1:, :width] = low
    steps = wide.view("<u8").ravel()
    steps[0] = np.array([first], np.int64).view(np.uint64)[0]
    return np.cumsum(steps, dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    kind = np.min_scalar_type(int(counts.max()))
    return bytes([kind.itemsize]) + zlib.compress(counts.astype(kind.newbyteorder("<")).tobytes(), 1)


def unpack_counts(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob[1:]), f"<u{blob[0]}").astype(np.int64)


def _edges(distinct: np.ndarray, buckets: int, size: int) -> np.ndarray:
    span = np.uint64((1 << _bits(size)) // buckets + 1)
    return np.append(np.searchsorted(distinct, np.arange(buckets, dtype=np.uint64) * span), len(distinct))


def _block(table: pa.Table) -> tuple[list, np.ndarray, list[bytes]]:
    """Rows of a block in one order whatever order they arrived in."""
    unpack = zstandard.ZstdDecompressor().decompress
    rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("held_out").to_pylist(), map(unpack, table.column("text").to_pylist())),
                  key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    return [r[0] for r in rows], np.array([not r[1] for r in rows]), [r[2] for r in rows]


def _report(own: Grams, size: int, wanted: np.ndarray | None, block: int, buckets: int) -> Iterator[tuple]:
    """Census rows of the n-grams of one length, or of the ``wanted`` ones."""
    distinct, trained = (own.distinct[size - 1], own.trained[size - 1]) if wanted is None else (own.distinct[size - 1][wanted], own.trained[size - 1][wanted])
    edges = _edges(distinct, buckets, size)
    for b in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
        part = slice(edges[b], edges[b + 1])
        yield (b, block, size, *pack_sorted(distinct[part]), pack_counts(trained[part]))


def _census_table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    names = ["bucket", "block", "size", "first", "width", "grams", "counts"]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(names), kinds)], names=names)


def census_of(order: int, buckets: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """All words and pairs of a block."""

    def census(key: tuple, table: pa.Table) -> pa.Table:
        _, learn, texts = _block(table)
        own = grams(texts, learn, min(order, 2))
        return _census_table([row for size in range(1, min(order, 2) + 1) for row in _report(own, size, None, key[0].as_py(), buckets)])

    return census


def _open(own: Grams, size: int, common: np.ndarray) -> np.ndarray:
    """The n-grams of a length of which both parts, a token shorter, occur in other blocks."""
    last = own.last[size - 1]
    return np.flatnonzero(common[own.at[size - 2][last]] & common[own.at[size - 2][last - 1]])


def longer_of(size: int, buckets: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """The n-grams of one length that may occur in other blocks."""

    def longer(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        _, learn, texts = _block(table)
        own = grams(texts, learn, size, least=min(size - 1, 2))
        common = _answers(own, answers, buckets, range(2, size))[0][size - 2]
        return _census_table(list(_report(own, size, _open(own, size, common), key[0].as_py(), buckets)))

    return longer


def total_bucket(key: tuple, table: pa.Table) -> pa.Table:
    """For the n-grams of each block: a bit whether another block has it, and of those the training count over all blocks."""
    parts = []
    for size in sorted(set(table.column("size").to_pylist())):
        rows = table.filter(pa.array([s == size for s in table.column("size").to_pylist()]))
        own = [unpack_sorted(*row) for row in zip(*(rows.column(c).to_pylist() for c in ("first", "width", "grams")))]
        counts = np.concatenate([unpack_counts(b) for b in rows.column("counts").to_pylist()])
        _, which, blocks = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        total = np.zeros(len(blocks), np.int64)
        np.add.at(total, which, counts)
        cuts = np.cumsum([0, *map(len, own)])
        shared = (blocks > 1)[which]
        for block, a, z in zip(rows.column("block").to_pylist(), cuts[:-1], cuts[1:]):
            bits = shared[a:z]
            parts.append((block, key[0].as_py(), size, np.packbits(bits).tobytes(), pack_counts(total[which[a:z][bits]]) if bits.any() else b""))
    kinds, names = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()], ["block", "bucket", "size", "common", "totals"]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*parts), kinds)], names=names)


def _answers(own: Grams, answers: pa.Table, buckets: int, sizes: range) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per length: which distinct n-grams occur in other blocks, and the training counts of all."""
    common, total = [np.zeros(len(d), bool) for d in own.distinct], [t.copy() for t in own.trained]
    told: dict[int, list[tuple]] = {}
    for size, *answer in zip(*(answers.column(c).to_pylist() for c in ("size", "bucket", "common", "totals"))):
        told.setdefault(size, []).append(tuple(answer))
    for size in sizes:
        asked = np.arange(len(own.distinct[size - 1])) if size <= 2 else _open(own, size, common[size - 2])
        edges = _edges(own.distinct[size - 1][asked], buckets, size)
        for b, bits, totals in told.get(size, ()):
            part = asked[edges[b] : edges[b + 1]]
            part = part[np.unpackbits(np.frombuffer(bits, np.uint8), count=len(part)).astype(bool)]
            if len(part):
                common[size - 1][part] = True
                total[size - 1][part] = unpack_counts(totals)
    return common, total


@dataclass
class Automaton:
    """States 0 (empty) and 1.. (histories); arcs sorted by ``state * span + word``."""

    span: int
    keys: np.ndarray
    weight: np.ndarray
    following: np.ndarray
    fail_weight: np.ndarray
    fail_state: np.ndarray
    begin: int

    def walk(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One word from every state, by failure arcs where there is no arc: log-probabilities and states."""
        total = np.zeros(len(state))
        arc = np.empty(len(state), np.int64)
        open_ = np.arange(len(state))
        state = state.copy()
        while len(open_):
            key = state[open_] * self.span + word[open_]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            arc[open_[hit]] = at[hit]
            open_ = open_[~hit]
            total[open_] += self.fail_weight[state[open_]]
            state[open_] = self.fail_state[state[open_]]
        return total + self.weight[arc], self.following[arc]


def automaton(own: Grams, totals: list[np.ndarray], order: int, n: int, v: int, pseudo: float) -> Automaton:
    """The arcs and states that a block's texts can reach; ``totals``: training counts of its distinct n-grams."""
    total = np.concatenate(totals)
    offset = np.cumsum([0, *map(len, totals)])
    size = len(total)
    begin = size + 1  # state of a text's start; n-gram g is state g + 1
    starts, ends = own.starts, own.starts + own.length - 1
    texts_learned = total[own.at[0][ends[0]]]
    seen = np.append(total, texts_learned)  # count of each state's history, by state - 1
    words = np.unique(own.at[0])
    log_p = np.zeros(size)
    log_p[words] = np.log10((total[words] + 0.5) / (n + 0.5 * (v + 1)))
    fail_state, fail_weight = np.zeros(size + 2, np.int64), np.zeros(size + 2)
    fail_weight[1:] = np.log10(pseudo / (seen + pseudo))
    is_state = lambda g: np.where(total[g] > 0, g + 1, 0)
    parts = [(words, log_p[words], is_state(words) if order > 1 else np.zeros(len(words), np.int64))]
    for k in range(1, order):
        first = own.last[k]
        known, lower = offset[k] + np.arange(len(first)), offset[k - 1] + own.at[k - 1][first]
        history = np.where(np.isin(first, starts), begin, offset[k - 1] + own.at[k - 1][first - 1] + 1)
        counted = seen[history - 1]
        p = (total[known] + pseudo * 10.0 ** log_p[lower]) / (counted + pseudo)
        log_p[known] = np.where(counted > 0, np.log10(p), log_p[lower])
        fail_state[known + 1] = is_state(lower)
        arcs = total[known] > 0
        goes = is_state(known if k < order - 1 else lower)
        parts.append((history[arcs] * size + own.at[0][first[arcs]], log_p[known[arcs]], goes[arcs]))
    keys, weight, following = (np.concatenate(c) for c in zip(*parts))
    by = np.argsort(keys)
    return Automaton(size, keys[by], weight[by], following[by], fail_weight, fail_state, begin)


def traverse(machine: Automaton, own: Grams, order: int, segment: int = SEGMENT) -> np.ndarray:
    """Log-probability of every text, walked in segments side by side."""
    lanes = -(-own.length // segment)
    text = np.repeat(np.arange(len(own.length)), lanes)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    lead = np.where(nth > 0, order - 1, 0)  # words walked before the segment, only for the state
    at = own.starts[text] + nth * segment - lead
    steps = np.minimum(segment, own.length[text] - nth * segment) + lead
    by = np.argsort(-steps, kind="stable")
    at, steps, lead, text = at[by], steps[by], lead[by], text[by]
    state = np.where(nth[by] > 0, 0, machine.begin if order > 1 else 0)
    total, word = np.zeros(len(text)), own.at[0]
    for t in range(int(steps.max()) if len(steps) else 0):
        k = int(np.searchsorted(-steps, -t, "left"))  # lanes with more than t steps
        gain, state[:k] = machine.walk(state[:k], word[at[:k] + t])
        total[:k] += np.where(lead[:k] <= t, gain, 0.0)
    return np.bincount(text, weights=total, minlength=len(own.length))


def traversal_of(order: int, buckets: int, n: int, v: int, pseudo: float) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def traversal(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        ids, learn, texts = _block(table)
        own = grams(texts, learn, order)
        totals = _answers(own, answers, buckets, range(1, order + 1))[1]
        word_total = totals[0][own.at[0]]
        text = np.repeat(np.arange(len(ids)), own.length)
        base = np.bincount(text, weights=np.log10((word_total + 0.5) / (n + 0.5 * (v + 1))), minlength=len(ids))
        score = traverse(automaton(own, totals, order, n, v, pseudo), own, order)
        return pa.table([
            pa.array(ids, pa.int64()), pa.array(~learn), pa.array(own.length), pa.array(np.bincount(text, weights=word_total > 0, minlength=len(ids)).astype(np.int64)),
            pa.array(np.full(len(ids), n, np.int64)), pa.array(base), pa.array(score),
        ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return traversal


def training_totals(source: DataFrame) -> tuple[int, int, int]:
    """Training tokens, distinct training tokens, and bytes of all texts: three numbers for the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, size, learned = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, 0

        def passed() -> pa.RecordBatch:
            token = pa.array([None, int(END.view(np.int64)), *held.view(np.int64).tolist()], pa.int64())
            return pa.RecordBatch.from_arrays([token, pa.array([size, learned, *counts.tolist()], pa.int64())], names=["token", "n"])

        for batch in batches:
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            own = [t for t, out in zip(texts, batch.column("held_out").to_pylist()) if not out]
            size, learned = size + sum(map(len, texts)), learned + len(own)
            words, n = np.unique(word_hashes(own)[0], return_counts=True)
            held, which = np.unique(np.concatenate([held, words]), return_inverse=True)
            counts = np.bincount(which, weights=np.concatenate([counts, n]), minlength=len(held)).astype(np.int64)
            if len(held) >= MERGED:
                yield passed()
                held, counts, size, learned = held[:0], counts[:0], 0, 0
        yield passed()

    counts = source.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    word, found = F.col("token").isNotNull(), F.col("n") > 0
    row = counts.agg(F.sum(F.when(word, F.col("n"))).alias("n"), F.count(F.when(word & found, 1)).alias("v"), F.sum(F.when(~word, F.col("n"))).alias("size")).first()
    return row["n"] or 0, row["v"], row["size"] or 0


def score(docs: DataFrame, order: int = ORDER, pseudo: float = PSEUDO) -> DataFrame:
    """Log10 probability of every whole text of ``docs(doc_id, text)``.

    The model learns from the texts whose crc32 of the id (as text) mod 5 is not 1. One row per
    row: ``doc_id, held_out, n_tokens`` (words and one end), ``n_known`` (tokens seen in
    training), ``train_tokens``, ``base_score`` (single tokens) and ``score`` (the automaton of
    ``order``). A null or empty text is one end; a null ``doc_id`` is kept and learned from; each
    of repeated rows counts; other columns are ignored; an empty table gives no rows. With no
    training text every token has probability 1, so both scores are 0.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("binary").alias("text"))
    n, v, size = training_totals(source)
    width = partitions(docs.sparkSession)
    blocks = max(width, -(-size // BLOCK_BYTES))
    buckets = max(width, -(-size * order // BUCKET_BYTES))

    def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield batch.set_column(2, "text", pa.array([pack(t or b"") for t in batch.column("text").to_pylist()], pa.binary()))

    dealt = source.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    texts = dealt.mapInArrow(compressed, "doc_id long, held_out boolean, text binary, block int").repartition(width, "block")
    by_bucket = lambda census: census.groupBy("bucket").applyInArrow(total_bucket, TOTALS)
    totals = by_bucket(texts.groupBy("block").applyInArrow(census_of(order, buckets), CENSUS))
    for k in range(3, order + 1):
        longer = texts.groupBy("block").cogroup(totals.where(F.col("size").between(2, k - 1)).groupBy("block")).applyInArrow(longer_of(k, buckets), CENSUS)
        totals = totals.unionByName(by_bucket(longer))
    return texts.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(traversal_of(order, buckets, n, v, pseudo), SCHEMA)
