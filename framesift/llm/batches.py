"""Arrow batches in pieces of bounded size, for functions that run in tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401

PIECE = 4 << 20


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, cut so that a column holds about ``most``
    bytes a piece, or one row that is larger. What Arrow holds in reserve is
    given back after each, as workers share an executor's memory and stay when idle."""
    pool = pa.default_memory_pool()
    for batch in batches:
        values = batch.column(column)
        lengths = pa.compute.binary_length(values).fill_null(0).to_numpy(zero_copy_only=False)
        start = held = 0
        for k, length in enumerate(lengths):
            if held + length > most and k > start:
                yield batch.slice(start, k - start)
                pool.release_unused()
                start, held = k, 0
            held += int(length)
        if start < len(lengths):
            yield batch.slice(start)
        pool.release_unused()
