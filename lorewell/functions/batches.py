"""Arrow batches in Python tasks, a few rows at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

# Rows turned into Python objects at once, and characters of text gathered before a batch is handed on.
SLICE_ROWS = 256
FLUSH_CHARS = 1 << 20


def small_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


def records(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of a batch as tuples; objects of a few rows exist at a time."""
    for part in small_batches([batch]):
        yield from zip(*(c.to_pylist() for c in part.columns))
