"""Encoding and decoding of whole texts with a word-level byte BPE (lower case, word ends).

Texts are split at special strings, normalised, and cut into pre-tokens. Merges of
a pre-token wait in a priority queue by rank over a doubly linked symbol list
(``merges.merge_symbols``). Decoding joins the vocabulary strings of the ids.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.functions.batches import small_batches
from lorewell.llm.merges import Cache, merge_symbols

SHORT = 24  # bytes of a pre-token up to which a scan of ranks is faster than a heap
NEVER = 1 << 64
SHORT_ENTRIES = 800_000  # pre-tokens with 16-bit ids that a worker keeps from task to task, about 200 bytes each
DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
TOKENS_SCHEMA = "doc_id long, n_tokens long, ids array<int>, decoded string"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = [""] * 256, 256
    for b in range(256):
        if b in shown:
            table[b] = chr(b)
        else:
            table[b], extra = chr(extra), extra + 1
    return table


# White_Space of Unicode, and lower-case mappings newer than Python's tables.
WHITE_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NEWER_LOWER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}

NEWER_UPPER = re.compile("[" + "".join(map(chr, NEWER_LOWER)) + "]").search
# Texts wholly below this character are split with small character classes, which give the same pieces sooner.
LATIN_END = 0x250
BEYOND_LATIN = re.compile(f"[{chr(LATIN_END)}-{chr(sys.maxunicode)}]").search

# Blocks of Unicode 16, which the vocabulary's library knows and Python's tables do not.
NEWER_BLOCKS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D8F), (0x10EC2, 0x10EC4), (0x11380, 0x113E2),
    (0x116D0, 0x116E3), (0x11BC0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x16139), (0x16D40, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5FF),
)


@lru_cache(maxsize=4)
def char_class(category: str, end: int) -> str:
    """Ranges of all characters below ``end`` of a major category, for use between brackets."""
    newer = {c for a, b in NEWER_BLOCKS for c in range(a, b + 1) if regex.match(rf"\p{{{category}}}", chr(c))}
    ranges: list[list[int]] = []
    for c in range(end):
        if unicodedata.category(chr(c))[0] == category or c in newer:
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ranges)


def builtin_pattern(pattern: str, end: int = sys.maxunicode + 1) -> str:
    """The file's pattern with its Unicode classes written out: faster, and independent of the pattern library's Unicode."""
    if pattern.count("|[\\p{L}]+|") == 1:  # no other alternative starts with a letter, so words may be tried first
        pattern = "[\\p{L}]+|" + pattern.replace("|[\\p{L}]+|", "|")
    pattern = pattern.replace("[\\p{N}]", "\\p{N}").replace("[\\p{L}]", "\\p{L}")
    for name, chars in (("\\p{L}", char_class("L", end)), ("\\p{N}", char_class("N", end)), ("\\s", WHITE_SPACE)):
        inside = re.sub(r"\[\^[^\]]*\]", lambda m: m[0].replace(name, chars), pattern)
        pattern = inside.replace(name, f"[{chars}]")
    return pattern


@dataclass
class WordBpe:
    """A vocabulary file's model, applied by the rules the file states."""

    ids: dict[str, int]
    ranks: dict[tuple[str, str], int]
    special: dict[str, int]
    pattern: str
    suffix: str
    strings: dict[int, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.strings = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.bytes = byte_symbols()
        self.inner, self.final = [self.ids[b] for b in self.bytes], [self.ids[b + self.suffix] for b in self.bytes]
        # two ids as one key: the rank of their merge and the id that it gives
        self.pairs = {self.ids[a] << 32 | self.ids[b]: r << 32 | self.ids[a + b] for (a, b), r in self.ranks.items()}
        self.split_any = re.compile(builtin_pattern(self.pattern)).findall
        self.split_latin = re.compile(builtin_pattern(self.pattern, LATIN_END)).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.cache = Cache(self._pre_token)
        self.short = Cache(lambda word: struct.pack(f"<{len(ids := self._merged(word))}H", *ids), entries=SHORT_ENTRIES)

    def _merged(self, word: str) -> list[int]:
        """Ids of a pre-token; few symbols are scanned for the smallest rank, by id, many go through the heap."""
        raw = word.encode("utf-8", "replace")
        if len(raw) > SHORT:
            symbols = [self.bytes[b] for b in raw]
            symbols[-1] += self.suffix
            ranks = self.ranks
            return [self.ids[s] for s in merge_symbols(symbols, lambda a, b: ranks.get((a, b)))]
        ids, step = [self.inner[b] for b in raw], self.pairs.get
        ids[-1] = self.final[raw[-1]]
        steps = [step(a << 32 | b, NEVER) for a, b in zip(ids, ids[1:])]
        while steps and (least := min(steps)) != NEVER:
            i = steps.index(least)
            del ids[i], steps[i]
            ids[i] = least & 0xFFFFFFFF
            if i:
                steps[i - 1] = step(ids[i - 1] << 32 | ids[i], NEVER)
            if i < len(steps):
                steps[i] = step(ids[i] << 32 | ids[i + 1], NEVER)
        return ids

    def _pre_token(self, word: str) -> tuple[bytes, str]:
        ids = self._merged(word)
        return struct.pack(f"<{len(ids)}I", *ids), " ".join([self.strings[i] for i in ids])

    @staticmethod
    def normal(text: str) -> str:
        """NFC and lower case; runs of white space stay, as no pre-token holds any."""
        if not BEYOND_LATIN(text):  # nothing composes, and no lower-casing depends on neighbours
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        # character by character: str.lower() would treat a final sigma by its neighbours
        text = "".join([c.lower() for c in text]) if "Σ" in text else text.lower()
        return text.translate(NEWER_LOWER) if NEWER_UPPER(text) else text

    def split(self, text: str) -> list[str]:
        return self.split_any(text) if BEYOND_LATIN(text) else self.split_latin(text)

    def parts(self, text: str) -> list[tuple[bytes, str]]:
        """Little-endian ids and decoded string of each pre-token and special string."""
        cached = self.cache.__getitem__
        if not any(s in text for s in self.special):
            return list(map(cached, self.split(self.normal(text))))
        found: list[tuple[bytes, str]] = []
        for place, piece in enumerate(self.cut(text)):
            if place % 2:
                found.append((np.array([self.special[piece]], "<u4").tobytes(), piece))
            else:
                found.extend(map(cached, self.split(self.normal(piece))))
        return found

    def encode_short(self, text: str) -> bytes:
        """Little-endian 16-bit ids of a text; all ids must fit."""
        cached = self.short.__getitem__
        if not any(s in text for s in self.special):
            return b"".join(map(cached, self.split(self.normal(text))))
        found: list[bytes] = []
        for place, piece in enumerate(self.cut(text)):
            found += [struct.pack("<H", self.special[piece])] if place % 2 else map(cached, self.split(self.normal(piece)))
        return b"".join(found)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(ids for ids, _ in self.parts(text)), "<u4")

    def decode(self, ids) -> str:
        """The vocabulary strings of ids, joined as the file's missing decoder does: by a space."""
        return " ".join([self.strings[int(i)] for i in ids])


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, splits = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
    kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
    if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None:
        raise ValueError(f"{path} is not a lower-casing word BPE without decoder")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return WordBpe(
        ids=model["vocab"], ranks={m: r for r, m in enumerate(merges)},
        special={t["content"]: t["id"] for t in spec["added_tokens"]},
        pattern=splits[0]["pattern"]["Regex"], suffix=model["end_of_word_suffix"],
    )


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [(t or b"").decode("utf-8", "replace") for t in batch.column(1).to_pylist()]


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text of ``docs(doc_id, text)``.

    A null text is empty; a null ``doc_id`` stays null; repeated rows give repeated
    results; other columns are ignored; an empty table gives no rows. Very long
    texts are hashed as one; pre-tokens are merged in n log n.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(vocabulary)
        for batch in batches:
            counts, encoded, decoded = [], [], []
            for text in _texts(batch):
                parts = codec.parts(text)
                ids = b"".join([p[0] for p in parts])
                counts.append(len(ids) // 4)
                encoded.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(" ".join([p[1] for p in parts]).encode("utf-8", "replace")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        codec.cache.clear()  # an idle worker holds no memory

    return _source(docs).mapInArrow(run, DIGEST_SCHEMA)


def encode_words(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id`` and, as ``text``, the little-endian 16-bit ids of every whole text; a text without tokens has none.

    A worker keeps its memo of pre-tokens for its later tasks, which mostly meet the same words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(vocabulary)
        if max(codec.strings) >= 0xFFFF:
            raise ValueError("ids do not fit 16 bits beside a separator")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(codec.encode_short, _texts(batch)), pa.binary())], names=["doc_id", "text"])

    return _source(docs).mapInArrow(run, "doc_id long, text binary")


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of every whole text; same rules as ``round_trip``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(vocabulary)
        for batch in small_batches(batches):
            ids = [codec.encode(t) for t in _texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, ids), pa.int64()), pa.array([i.astype("int32") for i in ids], pa.list_(pa.int32())), pa.array([codec.decode(i) for i in ids], pa.string())],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )
        codec.cache.clear()

    return _source(docs).mapInArrow(run, TOKENS_SCHEMA)
