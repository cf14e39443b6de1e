"""Embedding stage with a pluggable encoder."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_TEXTS = 100
VECTOR = T.ArrayType(T.FloatType(), containsNull=False)
ARROW_VECTOR = pa.list_(pa.field("element", pa.float32(), nullable=False))
# Words whose bucket an encoder remembers.
KNOWN_WORDS = 100_000

# An encoder maps a list of texts to one float vector per text.
Encoder = Callable[[list[str]], "np.ndarray"]


class EncodingError(Exception):
    """The encoder did not return one vector per text."""


class FeatureHashEncoder:
    """Deterministic offline encoder: signed token counts in hashed buckets, unit length."""

    _WORD = re.compile(r"[^\W_]+")

    def __init__(self, dimension: int = 256):
        self.dimension = dimension
        self._slots: dict[str, int] = {}

    def __getstate__(self):
        return {"dimension": self.dimension, "_slots": {}}

    def _slot(self, word: str) -> int:
        """Bucket of a word; words counted negatively have theirs in the upper half."""
        digest = hashlib.md5(word.encode("utf-8"), usedforsecurity=False).hexdigest()
        slot = int(digest[:8], 16) % self.dimension + (0 if int(digest[8], 16) < 8 else self.dimension)
        if len(self._slots) < KNOWN_WORDS:
            self._slots[word] = slot
        return slot

    def __call__(self, texts: list[str]) -> np.ndarray:
        known, slot, width = self._slots, self._slot, self.dimension
        counts = np.zeros((len(texts), 2 * width))
        for row, text in enumerate(texts):
            words = self._WORD.findall(text.lower())
            if words:
                try:
                    slots = [known[w] for w in words]
                except KeyError:
                    slots = [known[w] if w in known else slot(w) for w in words]
                counts[row] = np.bincount(slots, minlength=2 * width)
        out = counts[:, :width] - counts[:, width:]
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(length > 0, length, 1.0)).astype(np.float32)


def encode_udf(encoder: Encoder, batch: int = BATCH_TEXTS):
    """Iterator UDF: the encoder is set up once per task and called with at most ``batch`` texts."""

    @F.arrow_udf(VECTOR)
    def encode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            vectors = [pa.array([], ARROW_VECTOR)]
            for start in range(0, len(part), batch):
                sent = part.slice(start, batch).fill_null("").to_pylist()
                got = encoder(sent)
                if len(got) != len(sent):
                    raise EncodingError(f"sent {len(sent)} texts, got {len(got)} vectors")
                got = np.asarray(got, dtype=np.float32)
                offsets = np.arange(len(got) + 1, dtype=np.int32) * got.shape[1]
                vectors.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(got.ravel()), type=ARROW_VECTOR))
            yield pa.concat_arrays(vectors)

    return encode


def encode_column(df: DataFrame, text: str, encoder: Encoder, out: str = "embedding", batch: int = BATCH_TEXTS) -> DataFrame:
    return df.withColumn(out, encode_udf(encoder, batch)(F.col(text)))


def batch_number(index: Column | str, batch: int = BATCH_TEXTS) -> Column:
    """Which encoder call of its document a chunk belongs to."""
    i = F.col(index) if isinstance(index, str) else index
    return F.floor(i / batch).cast("int")
