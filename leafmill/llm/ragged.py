"""Fast access to list columns of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def flat(column: pa.Array) -> tuple[list, list[tuple[int, int]], list[bool]]:
    """(all elements in order, (from, to) of each row, whether the row is null) of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    first = int(offsets[0]) if len(offsets) else 0
    values = column.values.slice(first, int(offsets[-1]) - first if len(offsets) else 0)
    offsets = offsets - first
    items = values.to_numpy(zero_copy_only=False).tolist()
    valid = column.is_valid().to_pylist()
    return items, list(zip(offsets[:-1].tolist(), offsets[1:].tolist())), [not v for v in valid]


def coded(column: pa.Array) -> tuple[list, np.ndarray, list[tuple[int, int]]]:
    """(distinct elements, their numbers for all elements in order, (from, to) of each row) of a list column; a null row has no elements."""
    offsets = column.offsets.to_numpy()
    first = int(offsets[0]) if len(offsets) else 0
    values = column.values.slice(first, int(offsets[-1]) - first if len(offsets) else 0).dictionary_encode("encode")
    offsets = offsets - first
    return values.dictionary.to_pylist(), values.indices.to_numpy(), list(zip(offsets[:-1].tolist(), offsets[1:].tolist()))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches cut small, so that what is made of them in Python stays small too."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def rows(batch: pa.RecordBatch, lists: tuple[str, ...], plain: tuple[str, ...]):
    """One tuple per row: the ``plain`` columns' values, then each list column as a list (null: empty)."""
    ready = []
    for name in lists:
        items, spans, null = flat(batch.column(name))
        ready.append([[] if n else items[a:b] for (a, b), n in zip(spans, null)])
    return zip(*(batch.column(name).to_pylist() for name in plain), *ready)
