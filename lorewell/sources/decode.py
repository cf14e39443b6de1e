"""Arrow bridge for formats whose grammar needs a per-document decoder.

A decoder is a small function ``content -> iterable of blocks`` where a block
is ``(kind, text, heading_level, page_number, section_title)``. Documents never
leave their partition and block batches are flushed by size, so memory per task
is one document with its blocks plus one output batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lorewell.functions.batches import FLUSH_CHARS, records
from lorewell.schemas import BLOCKS

FLUSH_ROWS = 8192

_BLOCK_ARROW = [
    ("seq", pa.int64()), ("kind", pa.string()), ("text", pa.string()), ("heading_level", pa.int32()),
    ("page_number", pa.int32()), ("section_title", pa.string()), ("error", pa.string()),
]
_BLOCK_FIELDS = [f for f in BLOCKS.fields if f.name != "doc_id"] + [T.StructField("error", T.StringType())]


class DecodeError(Exception):
    """The content of one document cannot be read; the reason becomes a row."""


def decode_documents(
    docs: DataFrame,
    decoder: Callable[[object], Iterable[tuple]],
    content: str = "text",
    carry: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Blocks of every document; an unreadable one yields a single row with ``error`` set."""
    carried = [docs.schema[name] for name in carry]
    schema = T.StructType(carried + _BLOCK_FIELDS)
    text_at = schema.fieldNames().index("text", len(carry))

    def run(batches):
        for batch in batches:
            carried_type = [(f.name, f.type) for f in batch.schema][: len(carry)]
            arrow = pa.schema(carried_type + _BLOCK_ARROW)
            rows: list[tuple] = []
            chars = 0
            for record in records(batch):
                head, body = record[:-1], record[-1]
                # whatever a decoder trips over concerns this document only, and none of its blocks count then
                try:
                    found = [(*head, seq, *block, None) for seq, block in enumerate(decoder(body) if body is not None else ())]
                except DecodeError as fault:
                    found = [(*head, 0, None, None, None, None, None, str(fault))]
                except Exception as fault:
                    found = [(*head, 0, None, None, None, None, None, f"{type(fault).__name__}: {fault}")]
                for row in found:
                    rows.append(row)
                    chars += len(row[text_at] or "")
                    if len(rows) >= FLUSH_ROWS or chars >= FLUSH_CHARS:
                        yield _to_batch(rows, arrow)
                        rows, chars = [], 0
            if rows:
                yield _to_batch(rows, arrow)

    return docs.select(*carry, content).mapInArrow(run, schema)


def _to_batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(values, type=f.type) for values, f in zip(zip(*rows), arrow)]
    return pa.RecordBatch.from_arrays(columns, schema=arrow)


def readable(blocks: DataFrame) -> DataFrame:
    return blocks.filter("error IS NULL").drop("error")


def as_text(content: object) -> str:
    if isinstance(content, (bytes, bytearray, memoryview)):
        return bytes(content).decode("utf-8", errors="replace")
    return str(content)
