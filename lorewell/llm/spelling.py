"""Spelling variants: words one edit apart, grouped under their most frequent near word.

A search scheme for one error: cut a word in two; any near word holds the left half at its start
or the right half at its end. So each half is matched exactly, and the search goes on across the
other half allowing one error. Both searches run on suffix-rank intervals of an FM-index over the
delimited vocabulary: the right half is read from its end on the index of the words, the left half
from its start on the index of the reversed words. The two indexes are the two directions of one
bidirectional index; a delimiter bounds every word, so a search never turns round.

The vocabulary is in no place whole. A word is sent to the shards of its halves (for a word of
length l, the halves of words of length l - 1, l and l + 1), where it is indexed; in the shard of
its own halves it is also searched. A half that too many words share is refined: the part that may
hold the error is cut again, and either piece must match too, down to a single letter, after which a
group holds only words that are equal but for two letters at one place. A near word found by a left
piece is not counted again by the right one, so a word gets a few summary rows, never its list of pairs.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.llm.common import partitions, stored
from lorewell.llm.components import _roots

LETTERS, OCCURRENCES, RATIO, DAMAGE = 7, 2, 10, 31
SHARD_CHARS = 800_000  # letters indexed at once
BATCH = 4096  # words searched at once
HELD = 200_000  # distinct words counted in a task before they are passed on

FOUND = "word string, n_near long, best_n long, best string"

# a-z and U+00C0 to U+00FF are one byte each in Latin-1, in code-point order; 0 is the delimiter
_CODE = np.zeros(256, np.uint8)
_CODE[[*range(0x61, 0x7B), *range(0xC0, 0x100)]] = np.arange(1, 91)


def word_counts(docs: DataFrame, letters: int = LETTERS) -> DataFrame:
    """``word, n`` of the damaged runs with at least ``letters`` letters."""
    runs = re.compile(rf"[a-zÀ-ÿ]{{{letters},}}").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        crc32 = zlib.crc32

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seed = crc32(b":" if doc_id is None else b"%d:" % doc_id)
                for word in runs((text or b"").lower().decode("utf-8", "replace")):  # bytes: A-Z only
                    h = crc32(word.encode(), seed)
                    if h % DAMAGE == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < letters:
                            continue
                    held[word] = held.get(word, 0) + 1
                if len(held) >= HELD:
                    yield flush()
        yield flush()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class FmIndex:
    """Suffix ranks of the words ``$w0$w1...`` in ascending order; rank i < number of words is that of ``$wi``."""

    def __init__(self, words: list[bytes]):
        count = len(words)
        # the last word comes first: then equal ends of words are in the order of the delimiters behind them
        raw = np.frombuffer(words[-1] + b"\0" + b"".join(w + b"\0" for w in words[:-1]), np.uint8)
        present, code = np.unique(_CODE[raw], return_inverse=True)
        self.count, self.code = count, code.astype(np.int64)
        ends = np.flatnonzero(code == 0)
        begins = np.append(0, ends[:-1] + 1)
        self.begin, self.end = np.roll(begins, -1), np.roll(ends, -1)  # of each word in ``code``
        order = np.argsort(self._ranks(ends, len(present)), kind="stable")
        bwt = self.code[order - 1]
        blocks = len(bwt) // 64 + 1
        self.bits = np.zeros((blocks, len(present)), np.uint64)
        for c in range(len(present)):
            packed = np.packbits(bwt == c, bitorder="little")
            self.bits[:, c] = np.pad(packed, (0, blocks * 8 - len(packed))).view("<u8")
        inside = np.bitwise_count(self.bits).astype(np.int64)
        smaller = np.cumsum(np.append(0, inside.sum(axis=0)[:-1]))
        self.before = np.cumsum(inside, axis=0) - inside + smaller

    def _ranks(self, ends: np.ndarray, letters: int) -> np.ndarray:
        """Ranks of the suffixes, each up to its delimiter, by doubling; equal ones share a rank."""
        code, n = self.code, len(self.code)
        left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # letters before the delimiter
        bits = max(1, int(letters - 1).bit_length())
        span = 63 // bits
        padded = np.append(code, np.zeros(span, np.int64))
        key = np.zeros(n, np.int64)
        for j in range(span):
            key = (key << bits) | np.where(left >= j, padded[j : j + n], 0)
        rank = np.unique(key, return_inverse=True)[1]
        while span <= left.max():
            ahead = np.where(left >= span, rank[np.minimum(np.arange(n) + span, n - 1)] + 1, 0)
            rank = np.unique(rank * (int(rank.max()) + 2) + ahead, return_inverse=True)[1]
            span *= 2
        return rank

    def step(self, letter: np.ndarray | int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after one more letter to the left."""
        return self._step(letter, low), self._step(letter, high)

    def _step(self, letter, at: np.ndarray) -> np.ndarray:
        block, mask = at >> 6, (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block, letter] + np.bitwise_count(self.bits[block, letter] & mask)

    def children(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``node, letter, low, high`` of all letters (no delimiter) that go on from each interval, by node."""
        ends = []
        for at in (low, high):
            block, mask = at >> 6, (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ends.append(self.before[block] + np.bitwise_count(self.bits[block] & mask[:, None]))
        node, letter = np.nonzero(ends[1][:, 1:] > ends[0][:, 1:])
        return node, letter + 1, ends[0][node, letter + 1], ends[1][node, letter + 1]


def search(index: FmIndex, words: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of ``words``, word of the index) one edit apart whose edit lies in the letters a to b; each once.

    ``words``: letters of equally long words. They are read from the end; an edit at one of several
    equal places is made at the first one met (deletion) or the last one (insertion).
    """
    count, m = words.shape
    row = np.arange(count)
    low, high = np.zeros(count, np.int64), np.full(count, index.count)
    none = np.zeros(0, np.int64)
    off_row, off_low, off_high = none, none, none  # states with the edit behind them
    for p in range(m - 1, -2, -1):
        letter = words[:, p] if p >= 0 else np.zeros(count, np.int64)
        now, later = [(off_row, off_low, off_high)], []
        if a - 1 <= p < b:
            nodes, which = np.unique(low, return_inverse=True)
            top = np.zeros(len(nodes), np.int64)
            top[which] = high
            node, follow, child_low, child_high = index.children(nodes, top)
            first = np.searchsorted(node, np.arange(len(nodes) + 1))
            fan = np.diff(first)[which]
            who = np.repeat(row, fan)
            at = np.repeat(first[which] - (np.cumsum(fan) - fan), fan) + np.arange(int(fan.sum()))
            other = (follow[at] != letter[who]) | (p < a)
            edited = who[other], child_low[at[other]], child_high[at[other]]
            now.append(edited)  # inserted: this letter is still to come
            if p >= a:
                later.append(edited)  # replaced
                fresh = row if p == b - 1 else np.flatnonzero(letter != words[:, p + 1])
                later.append((fresh, low[fresh], high[fresh]))  # deleted
        off_row, off_low, off_high = (np.concatenate(c) for c in zip(*now))
        off_low, off_high = index.step(letter[off_row], off_low, off_high)
        alive = off_high > off_low
        later.append((off_row[alive], off_low[alive], off_high[alive]))
        off_row, off_low, off_high = (np.concatenate(c) for c in zip(*later))
        if p >= 0:
            low, high = index.step(letter, low, high)
    return off_row, off_low


def search_shard(table: pa.Table) -> pa.Table:
    """Summaries of the words searched in a shard: near words found here, and the best of them."""
    back = table.column("back")[0].as_py()
    turn = (lambda w: w[::-1]) if back else (lambda w: w)
    raw = [turn(w.encode("latin-1")) for w in table.column("word").to_pylist()]
    number = table.column("n").to_numpy()
    words, first = [], []
    for i in sorted(range(len(raw)), key=raw.__getitem__):
        if not words or words[-1] != raw[i]:
            words.append(raw[i])
            first.append(i)
    n = number[first]
    place = {w: i for i, w in enumerate(words)}
    plain = [turn(w) for w in words]
    alphabetic = np.empty(len(words), np.int64)
    alphabetic[sorted(range(len(words)), key=plain.__getitem__)] = np.arange(len(words))
    index = FmIndex(words)
    asked: dict[tuple, list[int]] = {}
    for i, (query, m, a, b) in enumerate(zip(*(table.column(c).to_pylist() for c in ("query", "m", "a", "b")))):
        if query:
            asked.setdefault((m, a, b), []).append(place[raw[i]])
    out = []
    for (m, a, b), queries in asked.items():
        for at in range(0, len(queries), BATCH):
            own = np.array(queries[at : at + BATCH])
            letters = index.code[index.begin[own][:, None] + np.arange(m)]
            row, near = search(index, letters, *((m - b, m - a) if back else (a, b)))
            if b < m:  # found by the left piece already
                same = np.ones(len(row), bool)
                for t in range(b):
                    mine, theirs = (index.end[own[row]] - 1 - t, index.end[near] - 1 - t) if back else (index.begin[own[row]] + t, index.begin[near] + t)
                    same &= index.code[mine] == index.code[theirs]
                row, near = row[~same], near[~same]
            by = np.lexsort((alphabetic[near], -n[near], row))
            row, near = row[by], near[by]
            heads = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
            size = np.diff(np.append(heads, len(row)))
            out += zip((plain[own[r]] for r in row[heads]), size.tolist(), n[near[heads]].tolist(), (plain[w] for w in near[heads]))
    word, size, best_n, best = zip(*out) if out else ((), (), (), ())
    text = lambda column: pa.array([w.decode("latin-1") for w in column], pa.string())
    return pa.table({"word": text(word), "n_near": pa.array(size, pa.int64()), "best_n": pa.array(best_n, pa.int64()), "best": text(best)})


def _keyed(rows: DataFrame) -> DataFrame:
    """The group of a row: the length it is looked for with, where the error may be, and the letters around that."""
    left, right = F.substring("word", F.lit(1), F.col("a")), F.substring("word", F.length("word") - F.col("m") + F.col("b") + 1, F.col("m") - F.col("b"))
    return rows.withColumn("key", F.xxhash64("m", "a", "b", left, right))


def _cut(rows: DataFrame) -> DataFrame:
    """Both refinements of the part that may hold the error: its left or its right piece matches."""
    half = (F.col("a") + F.floor((F.col("b") - F.col("a")) / 2)).cast("int")
    cuts = F.array(F.struct(half.alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), half.alias("b")))
    return _keyed(rows.withColumn("cut", F.explode(cuts)).select("word", "n", "m", "query", "cut.a", "cut.b"))


def dealt(words: DataFrame, limit: int = SHARD_CHARS) -> DataFrame:
    """``word, n, m, a, b, query, back, shard``: every word in every shard where it may be found or is searched."""
    length = F.length("word")
    total = words.agg(F.sum(length + 1).alias("t")).first()["t"] or 0
    each = max(partitions(words.sparkSession) // 2, -(-3 * total // limit), 1)
    whole = words.withColumn("m", F.explode(F.array(length - 1, length, length + 1))).select("word", "n", "m", (F.col("m") == length).alias("query"), F.lit(0).alias("a"), F.col("m").alias("b"))
    rows, done = _cut(whole), None
    while True:
        held = rows.groupBy("key").agg(F.sum(F.length("word") + 1).alias("size"), F.max(F.col("b") - F.col("a")).alias("open"))
        crowded = stored(held.where((F.col("size") > limit) & (F.col("open") > 1)).select("key"), "crowded")
        if not crowded.limit(1).count():
            break
        settled = rows.join(crowded, "key", "left_anti")
        done = settled if done is None else done.unionByName(settled)
        rows = stored(_cut(rows.join(crowded, "key", "left_semi").drop("key")), "refined")
    rows = rows if done is None else done.unionByName(rows)
    back: Column = F.col("a") >= F.col("m") - F.col("b")
    return rows.select("word", "n", "m", "a", "b", "query", back.alias("back"), (F.pmod("key", F.lit(each)) * 2 + back.cast("long")).alias("shard"))


def near_words(words: DataFrame, limit: int = SHARD_CHARS) -> DataFrame:
    """``word, n_near, best_n, best`` of the words that have a near word in ``words(word, n)``."""
    found = dealt(words, limit).groupBy("shard").applyInArrow(search_shard, FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.minus")).alias("best_n"), "b.best")


def variants(docs: DataFrame, ratio: int = RATIO, limit: int = SHARD_CHARS) -> DataFrame:
    """Words of ``docs(doc_id, text)`` with their more frequent spelling, a row per word.

    Words are the damaged runs of A-Z, a-z and U+00C0 to U+00FF (lower-cased A-Z) with at least 7
    letters that occur twice or more. ``word, form, root, n, n_near, form_n``: the form is the near word
    of largest ``n`` (ties: smallest) if that is ``ratio`` times the word's ``n`` or more, else null; the
    root ends the chain of forms. A null text has no words; a null ``doc_id`` is empty in the
    hash of the damage; repeated rows count each; other columns are ignored; an empty table gives no rows.
    """
    words = stored(word_counts(docs).where(F.col("n") >= OCCURRENCES), "words")
    near = words.join(near_words(words, limit), "word", "left")
    formed = F.col("best_n") >= ratio * F.col("n")
    rows = stored(near.select("word", F.when(formed, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best_n")).alias("form_n")), "forms")
    # every form has ten times the occurrences, so chains are short; roots are followed by doubling
    roots = _roots(rows.where(F.col("form").isNotNull()).select(F.col("word").alias("node"), F.col("form").alias("parent")))
    out = rows.join(roots.select(F.col("node").alias("word"), F.col("parent").alias("root")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
