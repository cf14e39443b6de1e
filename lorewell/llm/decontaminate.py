"""Documents that leak benchmark items, found by latent semantic retrieval.

Documents are cut into passages of ``PASSAGE`` words. Passages are rows of a TF-IDF matrix whose
columns are the words of the benchmark; the items are further rows, heavy enough that the latent
space holds them. Copies of a passage count once, so no group of copies makes its own words
common, and every word keeps a weight. A randomised SVD gives the latent space: the matrix is multiplied by itself
and a random block in tasks, only (words x rank) sums come to the driver. Overlapping passages
whose latent cosine with an item reaches ``COSINE`` are candidates. So is, whatever its words
weigh, every stretch about as long as an item that holds 60 % of the item's words. A candidate is a leak if the
longest common subsequence with the item, in the passage and its surroundings, holds 80 % of
the item's words, or 60 % together with half of its answer (its last sentence): paraphrases keep
the order of most words.

The benchmark is taken in blocks of ``ITEMS`` items and ``ITEM_BYTES`` bytes, so what a task holds is
bounded; each block has its own columns and latent space, fitted on all passages.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions.batches import small_batches
from lorewell.llm.common import stored

ITEMS, ITEM_BYTES = 256, 1 << 20
PASSAGE, STRIDE = 32, 16
COSINE = 0.3
EXTRA_RANK = 64
GRAM, PAIRS = 4096, 1 << 18  # words of which a task sums all pairs, and pairs summed at once
GROUP, ROWS = 1 << 15, 1 << 12  # words of short texts that are searched together, and their rows that are counted at once
PIECE = 32  # strides of a text whose words are counted against the items at once
SCHEMA = "doc_id long, item_id long, cosine double, begin int, common_words int, item_words int, answer_share double"

_PLAIN = bytes(32 if chr(b) in "\t\n\v\f\r.,;:!?\"()[]{}|*#%$&<>/\\~`^=+" else b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words without ASCII punctuation, apart from inner hyphens and apostrophes."""
    return text.translate(_PLAIN).split()


def answer_words(text: bytes) -> list[bytes]:
    """Words of the last sentence; of the last third if there is but one."""
    sentences = [w for s in re.split(rb"[.!?\n]+", text) if (w := words_of(s))]
    if len(sentences) > 1:
        return sentences[-1]
    words = words_of(text)
    return words[len(words) * 2 // 3 :]


def common_subsequence(item: list[bytes], words: list[bytes]) -> int:
    """Length of the longest common subsequence, one big-integer step per word."""
    masks: dict[bytes, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in words:
        if m := masks.get(w):
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


def leaks(item: list[bytes], answer: list[bytes], words: list[bytes]) -> tuple[int, float] | None:
    """Common words and share of the answer, if the words leak the item."""
    common = common_subsequence(item, words)
    if 10 * common < 6 * len(item):
        return None
    share = common_subsequence(answer, words) / len(answer)
    return (common, share) if 10 * common >= 8 * len(item) or share >= 0.5 else None


@dataclass
class Block:
    """Items of one block, their words, weights and latent vectors."""

    ids: list[int]
    words: list[list[bytes]]
    answers: list[list[bytes]]
    vocabulary: dict[bytes, int]
    weight: np.ndarray | None = None
    unknown: float = 1.0
    space: np.ndarray | None = None
    items: np.ndarray | None = None
    norms: np.ndarray | None = None

    def terms(self, text: bytes) -> tuple[list[bytes], np.ndarray]:
        words = words_of(text)
        return words, np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int32, len(words))


def _blocks(benchmark: DataFrame) -> Iterator[Block]:
    """The benchmark in blocks of bounded size, in order of id."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    ids, words, answers, size = [], [], [], 0

    def block() -> Block:
        return Block(ids, words, answers, {w: i for i, w in enumerate(sorted({w for ws in words for w in ws}))})

    for row in rows.orderBy("item_id", "text").toLocalIterator():
        text = bytes(row["text"])
        if ids and (len(ids) >= ITEMS or size + len(text) > ITEM_BYTES):
            yield block()
            ids, words, answers, size = [], [], [], 0
        if found := words_of(text):
            ids.append(row["item_id"])
            words.append(found)
            answers.append(answer_words(text))
            size += len(text)
    if ids:
        yield block()


def _passages(texts: DataFrame, block: Block) -> DataFrame:
    """The distinct passages as sorted lists of terms, with repetitions; a passage without a known word is an empty list."""

    width = len(block.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows: dict[bytes, np.ndarray] = {}
            for text in batch.column(1).to_pylist():
                words, terms = block.terms(text or b"")
                for a in range(0, len(words), PASSAGE):
                    digest = hashlib.blake2b(b" ".join(words[a : a + PASSAGE]), digest_size=16).digest()
                    if digest not in rows:
                        rows[digest] = terms[a : a + PASSAGE]
            own = np.concatenate(list(rows.values())) if rows else np.zeros(0, np.int32)
            passage = np.repeat(np.arange(len(rows)), [len(r) for r in rows.values()])[own >= 0]
            terms = np.sort(passage * width + own[own >= 0]) % width if width else own
            offsets = pa.array(np.append(0, np.cumsum(np.bincount(passage, minlength=len(rows)))), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32()))], names=["digest", "terms"])

    return stored(texts.mapInArrow(run, "digest binary, terms array<int>").dropDuplicates(["digest"]).select("terms"), "passages")


def _counts(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passage, term and count of every distinct term of every passage."""
    lengths = np.diff(column.offsets.to_numpy())
    terms, passage = column.flatten().to_numpy(), np.repeat(np.arange(len(lengths)), lengths)
    if not len(terms):
        return passage, terms, passage
    heads = np.flatnonzero(np.append(True, (terms[1:] != terms[:-1]) | (passage[1:] != passage[:-1])))
    return passage[heads], terms[heads], np.diff(np.append(heads, len(terms)))


def _weigh(rows: DataFrame, block: Block) -> None:
    """Document frequencies of the block's words over the distinct passages, and their weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, passages = np.zeros(len(block.vocabulary), np.int64), 0
        for batch in batches:
            total += np.bincount(_counts(batch.column(0))[1], minlength=len(total))
            passages += batch.num_rows
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1), pa.int32()), pa.array(np.append(total[used], passages), pa.int64())], names=["term", "n"])

    frequency, passages = np.zeros(len(block.vocabulary)), 0
    for term, n in rows.mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n")).collect():  # at most the words of a block
        if term < 0:
            passages = n
        else:
            frequency[term] = n
    block.weight = np.log1p(0.05 * max(passages, 1) / np.maximum(frequency, 1))
    # other words weigh what a known one weighs on average, which does not grow with the corpus
    block.unknown = float(np.average(block.weight, weights=frequency if frequency.any() else None))


class _Pairs:
    """Sums of a' a over rows of a task, a word with a word, taken times a basis at the end."""

    def __init__(self, words: int):
        self.words, self.sums = words, np.zeros(words * (words + 1) // 2)

    def add(self, terms: np.ndarray, values: np.ndarray, lengths: np.ndarray) -> None:
        """Rows of ``lengths`` distinct, sorted terms."""
        heads = np.cumsum(lengths) - lengths
        for n in np.unique(lengths[lengths > 0]).tolist():
            of, upper = heads[lengths == n], np.tril_indices(n)
            for a in range(0, len(of), step := max(1, PAIRS // len(upper[0]))):
                at = of[a : a + step, None] + np.arange(n)
                t, v = terms[at].astype(np.int64), values[at]
                np.add.at(self.sums, ((t * (t + 1) // 2)[:, upper[0]] + t[:, upper[1]]).ravel(), (v[:, upper[0]] * v[:, upper[1]]).ravel())

    def times(self, basis: np.ndarray) -> np.ndarray:
        out = np.zeros(basis.shape, np.float32)
        for a in range(0, self.words, 256):
            b = min(a + 256, self.words)
            lower = np.zeros((b - a, b), np.float32)
            for t in range(a, b):
                lower[t - a, : t + 1] = self.sums[t * (t + 1) // 2 : (t + 1) * (t + 2) // 2]
            out[a:b] += lower @ basis[:b]
            lower[np.arange(b - a), np.arange(a, b)] = 0
            out[:b] += lower.T @ basis[a:b]
        return out


def _times_itself(rows: DataFrame, block: Block, basis: np.ndarray) -> np.ndarray:
    """Sum over passages of a' a basis; each task adds up its own rows.

    Up to ``GRAM`` words a task sums the pairs of words of its passages, and multiplies once; a passage then costs the
    square of its few known words. Above, where the pairs would not fit a task, every passage is multiplied by the basis.
    """
    weight, width, tile, few = block.weight, basis.shape[1], 256, len(block.vocabulary) <= GRAM
    small = basis.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, pairs = np.zeros(basis.shape, np.float32), _Pairs(len(basis)) if few else None
        for batch in batches:
            passage, terms, counts = _counts(batch.column(0))
            held = np.bincount(passage, minlength=batch.num_rows)
            if pairs:
                pairs.add(terms, np.log1p(counts) * weight[terms], held)
                continue
            offsets = np.append(0, np.cumsum(held))
            for a in range(0, len(offsets) - 1, 256):  # what a step holds stays in the processor's cache
                cut = offsets[a : a + 257]
                t, c = terms[cut[0] : cut[-1]], counts[cut[0] : cut[-1]]
                if not len(t):
                    continue
                value = (np.log1p(c) * weight[t]).astype(np.float32)
                heads, lengths = cut[:-1] - cut[0], np.diff(cut)
                wide = small[t]
                wide *= value[:, None]
                product = np.add.reduceat(wide, heads[lengths > 0], axis=0)
                order = np.argsort(t, kind="stable")
                t = t[order]
                np.take(product, np.repeat(np.arange(len(product)), lengths[lengths > 0])[order], axis=0, out=wide)
                wide *= value[order][:, None]
                first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
                total[t[first]] += np.add.reduceat(wide, first, axis=0)
        if pairs:
            total = pairs.times(small)
        tiles = [i for i in range(0, len(total), tile) if total[i : i + tile].any()]
        yield pa.RecordBatch.from_arrays([pa.array(tiles, pa.int32()), pa.array([total[i : i + tile].tobytes() for i in tiles], pa.binary())], names=["tile", "part"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(p, np.float32).astype(np.float64) for p in table.column("part").to_pylist()]
        return pa.table({"tile": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([reduce(np.add, parts).tobytes()], pa.binary())})

    out = np.zeros(basis.shape)
    sums = rows.mapInArrow(run, "tile int, part binary").groupBy("tile").applyInArrow(add, "tile int, part binary")
    for at, part in sums.collect():  # words of a block x rank
        values = np.frombuffer(bytes(part), np.float64).reshape(-1, width)
        out[at : at + len(values)] = values
    return out


def _item_rows(block: Block) -> np.ndarray:
    rows = np.zeros((len(block.ids), len(block.vocabulary)))
    for i, words in enumerate(block.words):
        terms, counts = np.unique([block.vocabulary[w] for w in words], return_counts=True)
        rows[i, terms] = np.log1p(counts) * block.weight[terms]
    return rows


def _fit(texts: DataFrame, block: Block) -> None:
    """Latent space of the block by a randomised SVD: a random range, then the matrix within it."""
    rows = _passages(texts, block)
    _weigh(rows, block)
    items = _item_rows(block)
    norms = np.sqrt((items**2).sum(axis=1))
    rank = min(len(block.vocabulary), len(block.ids) + EXTRA_RANK)
    basis = np.random.default_rng(11).standard_normal((len(block.vocabulary), min(len(block.vocabulary), rank + 8)))
    product = _times_itself(rows, block, basis)
    # items outweigh the strongest direction of the passages
    heavy = 10 * max(np.abs(product).max(), 1.0) / max((norms**2).min(initial=np.inf, where=norms > 0), 1e-9) if (norms > 0).any() else 0.0
    basis, _ = np.linalg.qr(product + heavy * (items.T @ (items @ basis)))
    inner = basis.T @ (_times_itself(rows, block, basis) + heavy * (items.T @ (items @ basis)))
    _, vectors = np.linalg.eigh((inner + inner.T) / 2)
    block.space = (basis @ vectors[:, ::-1][:, :rank]).astype(np.float32)
    block.items, block.norms = (items @ block.space).astype(np.float32), norms


def _find(texts: DataFrame, block: Block) -> DataFrame:
    # what a word adds to the cosine of a passage with each item, but for the passage's norm
    pull = (block.space * block.weight.astype(np.float32)[:, None]) @ (block.items / np.maximum(block.norms, 1e-9)[:, None]).T.astype(np.float32)
    plain = replace(block, space=None, items=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(plain, pull)
        for batch in batches:
            out: list[tuple] = []
            group, size = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, terms = plain.terms(text or b"")
                if not len(words) or terms.max() < 0:
                    continue
                if group and size + len(words) > GROUP:
                    out += search.hits(group)
                    group, size = [], 0
                group.append((doc, words, terms))
                size += len(words)
            if group:
                out += search.hits(group)
            columns = list(zip(*out)) if out else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "cosine", "begin", "common_words", "item_words", "answer_share"])

    return texts.mapInArrow(run, SCHEMA)


def _occurrences(block: Block) -> np.ndarray:
    """How often a word (row) is in an item (column)."""
    longest = max(map(len, block.words))
    times = np.zeros((len(block.vocabulary), len(block.ids)), np.uint16 if longest < 1 << 16 else np.uint32)
    for i, words in enumerate(block.words):
        terms, counts = np.unique([block.vocabulary[w] for w in words], return_counts=True)
        times[terms, i] = counts
    return times


class Search:
    """Leaks of a block's items in groups of documents.

    The words of a group are laid out in rows of ``STRIDE``, with empty rows between documents, so that no
    passage or stretch crosses from one to the next. A passage is a row and the row behind it.
    """

    def __init__(self, block: Block, pull: np.ndarray):
        # padding and unknown words have rows of their own at the end of every table
        self.block, self.n_items, self.n_words = block, len(block.ids), len(block.vocabulary)
        self.times = np.concatenate([_occurrences(block), np.zeros((2, self.n_items), np.uint16)])
        self.by_item = np.ascontiguousarray(self.times.T).ravel()
        self.pull = np.concatenate([pull, np.zeros((2, self.n_items), np.float32)])
        self.most_pull = np.maximum(self.pull.max(axis=1), 0).astype(np.float64)
        self.mass = np.concatenate([block.weight**2, [0, 0]])
        self.square = np.concatenate([block.weight**2, [0, block.unknown**2]])
        sizes = np.array([len(w) for w in block.words])
        self.needed, self.strides = -(-6 * sizes // 10), -(-(sizes - 1) // STRIDE) + 1
        self.longest = int(self.strides.max())

    def held(self, rows: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Places (passage * items + item) in stretches with 60 % of an item's words, for items of any weight.

        A stretch is the fewest whole strides that hold any run of as many words as the item has.
        Its words are counted with their occurrences in the item, so no such common subsequence is missed.
        Parts of texts, then their stretches, are ruled out by sums that can only be larger.
        """
        piece = max(PIECE, 2 * self.longest)
        parts = [(f + a, min(piece, n - a), min(piece + self.longest - 1, n - a)) for f, n in zip(first.tolist(), counts.tolist()) for a in range(0, n, piece)]
        begin, starts, length = (np.array(c) for c in zip(*parts))
        width = len(self.times)
        at = np.repeat(begin - np.cumsum(length) + length, length) + np.arange(length.sum())
        key = (np.repeat(np.arange(len(parts)), length)[:, None] * width + rows[at]).ravel()
        key = np.unique(key[rows[at].ravel() < self.n_words])
        part, term = np.divmod(key, width)
        heads = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else part
        # a part's distinct words are bounded by its words; sums of an item's occurrences by the item's size
        sums = np.stack([np.add.reduce(self.times[term[a:b]], axis=0, dtype=self.times.dtype) for a, b in zip(heads, np.append(heads[1:], len(part)))]) if len(heads) else np.zeros((0, self.n_items), self.times.dtype)
        which, item = np.nonzero(sums >= self.needed)
        which = part[heads][which]
        found = []
        ends = np.cumsum(length[which])
        for some in np.split(np.arange(len(which)), np.searchsorted(ends, np.arange(ROWS, ends[-1], ROWS))) if len(which) else []:
            if len(some):
                found += self.stretches(rows, begin[which[some]], starts[which[some]], length[which[some]], item[some])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def stretches(self, rows: np.ndarray, begin: np.ndarray, starts: np.ndarray, length: np.ndarray, item: np.ndarray) -> list[np.ndarray]:
        """The places of parts, each with one item."""
        offset = np.cumsum(length) - length
        inside = np.arange(length.sum()) - np.repeat(offset, length)
        at, own, end = np.repeat(begin, length) + inside, np.repeat(item, length), np.repeat(offset + length, length)
        sums = np.append(0, np.cumsum(self.by_item.take(own[:, None] * len(self.times) + rows[at]).sum(axis=1, dtype=np.int64)))
        here = np.arange(len(at))
        enough = sums[np.minimum(here + self.strides[own], end)] - sums[here] >= self.needed[own]
        enough &= inside < np.repeat(starts, length)
        at, own, left = at[enough], own[enough], (end - here)[enough]
        found = []
        for n in np.unique(self.strides[own]).tolist():
            some = self.strides[own] == n
            for a in range(0, int(some.sum()), step := max(1, ROWS // n)):
                s, i, most = at[some][a : a + step], own[some][a : a + step], left[some][a : a + step]
                row = np.minimum(np.arange(n), most[:, None] - 1) + s[:, None]  # the last row of a text again, which adds nothing
                terms = np.sort(rows[row].reshape(len(s), -1), axis=1)
                terms[:, 1:][terms[:, 1:] == terms[:, :-1]] = self.n_words
                good = self.by_item.take(i[:, None] * len(self.times) + terms).sum(axis=1, dtype=np.int64) >= self.needed[i]
                found += [(s[good] + k) * self.n_items + i[good] for k in range(max(n - 1, 1))]
        return found

    def cosines(self, rows: np.ndarray, passages: np.ndarray, norm: np.ndarray) -> np.ndarray:
        terms = np.sort(np.concatenate([rows[passages], rows[passages + 1]], axis=1), axis=1)
        known = (terms < self.n_words).sum(axis=1)
        latent = np.zeros((len(passages), self.n_items), np.float32)
        for j in range(int(known.max(initial=0))):
            more = np.flatnonzero(known > j)
            latent[more] += self.pull[terms[more, j]]
        return latent / norm[:, None]

    def hits(self, group: list[tuple]) -> Iterator[tuple]:
        """Rows of the result for ``(doc_id, words, terms)`` of some documents."""
        counts = np.array([-(-len(words) // STRIDE) for _, words, _ in group])
        step = counts + max(self.longest - 1, 1)
        first = np.cumsum(step) - step
        flat = np.full(int(step.sum()) * STRIDE, -2, np.int32)
        for f, (_, words, terms) in zip(first.tolist(), group):
            flat[f * STRIDE : f * STRIDE + len(words)] = terms
        flat[flat < 0] += self.n_words + 2
        rows = flat.reshape(-1, STRIDE)
        held = self.held(rows, first, counts)
        both = lambda table: (one := table[rows].sum(axis=1)) + np.append(one[1:], 0)
        norm, known = np.sqrt(both(self.square)), (rows < self.n_words).any(axis=1)
        own = known | np.append(known[1:], False)
        own &= np.repeat(np.tile([True, False], len(group)), np.stack([counts, step - counts], axis=1).ravel())
        held = held[own[held // self.n_items]]
        # a projection is no longer than what it projects, and no item is pulled to more than by the most that each word can
        near = own & (both(self.mass) >= (COSINE * norm) ** 2) & (both(self.most_pull) >= (COSINE - 1e-3) * norm)
        held_in = np.unique(held // self.n_items)
        latent = near.copy()
        latent[held_in] = True
        use = np.flatnonzero(latent)
        cells, scores = [], []
        for a in range(0, len(use), 1024):
            some = use[a : a + 1024]
            cosine = self.cosines(rows, some, norm[some])
            close = cosine >= COSINE
            mine = held[np.searchsorted(held, some[0] * self.n_items) : np.searchsorted(held, (some[-1] + 1) * self.n_items)]
            close[np.searchsorted(some, mine // self.n_items), mine % self.n_items] = True
            at, which = np.nonzero(close)
            cells.append(some[at] * self.n_items + which)
            scores.append(cosine[at, which])
        best: dict[tuple[int, int], list] = {}
        if cells:
            place, which = np.divmod(np.concatenate(cells), self.n_items)
            doc = np.searchsorted(first, place, side="right") - 1
            for d, i, begin, score in zip(doc.tolist(), which.tolist(), ((place - first[doc]) * STRIDE).tolist(), np.concatenate(scores).tolist()):
                best.setdefault((d, i), []).append((begin, score))
        for (d, i), places in best.items():
            yield from _leak(self.block, i, places, group[d])


def _leak(block: Block, i: int, places: list[tuple[int, float]], document: tuple) -> Iterator[tuple]:
    """The strongest leak of an item around passages of a document, in order of place."""
    doc, words, _ = document
    item = block.words[i]
    reach = len(item)
    found = None
    stop = -1
    for begin, _ in places:  # neighbouring passages are one stretch
        if begin + PASSAGE + reach <= stop:
            continue
        last = begin
        for other, _ in places:
            if last < other <= last + PASSAGE:
                last = other
        stop = last + PASSAGE + reach
        hit = leaks(item, block.answers[i], words[max(0, begin - reach) : stop])
        if hit and (found is None or hit > found[1]):
            found = (begin, hit)
    if found:
        yield doc, block.ids[i], max(c for _, c in places), found[0], found[1][0], len(item), found[1][1]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Leaks of ``benchmark(item_id, text)`` in ``docs(doc_id, text)``, a row per document and item.

    ``doc_id, item_id, cosine, begin`` (a word near the leak), ``common_words, item_words,
    answer_share``. Null or empty texts leak nothing; items without words or with a null
    id are left out; a null ``doc_id`` is reported as null; rows that repeat a ``doc_id``
    or an item give one row for each pair of ids, the strongest. Other columns are ignored;
    with an empty table on either side there are no rows. Long texts are cut into passages.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    found = None
    for block in _blocks(benchmark):
        _fit(texts, block)
        hits = _find(texts, block)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    strongest = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("common_words"), F.desc("cosine"), "begin")
    return found.withColumn("_rank", F.row_number().over(strongest)).where("_rank = 1").drop("_rank")
