"""Arrow batches in pieces of bounded size, so that a worker's objects do not grow with the batches that it is sent."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are Python objects at a time, besides one text, which is whole however large.
PIECE_BYTES = 1 << 20


def _sizes(column: pa.Array) -> np.ndarray:
    """About how many bytes each row takes as objects."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) * 64
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def cuts(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows, in order, of about ``limit`` bytes each."""
    if not len(column):
        return
    group = np.cumsum(_sizes(column) + 64) // limit
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    yield from zip(starts.tolist(), [*starts[1:].tolist(), len(column)])


def pieces(batch: pa.RecordBatch, name: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices, by the size of one of its columns."""
    for a, b in cuts(batch.column(name), limit):
        yield batch.slice(a, b - a)


def release() -> None:
    """Give freed memory back: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mapped(kind: pa.DataType, make: Callable[..., list], first: pa.Array, *others: pa.Array) -> pa.Array:
    """``make`` over the rows of the columns, piece by piece, as one array."""
    out = [pa.array(make(*(c.slice(a, b - a).to_pylist() for c in (first, *others))), kind) for a, b in cuts(first)]
    made = pa.concat_arrays(out) if out else pa.array([], kind)
    out.clear()
    release()
    return made


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same task, which gives freed memory back at its end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped
