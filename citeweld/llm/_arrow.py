"""Small helpers for functions that run on Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa


def ints(column: pa.Array | pa.ChunkedArray, kind: type = np.int64) -> np.ndarray:
    """An integer column without nulls as numpy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.to_numpy(zero_copy_only=False).astype(kind, copy=False)


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """A list column: the first lengths[0] values, then the next lengths[1], ..."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def batch(**columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in columns.values()], names=list(columns))


def whole_groups(batches: Iterable[pa.RecordBatch], key: str, rows: int = 50_000) -> Iterator[pa.Table]:
    """Batches that come sorted by key, as tables of about ``rows`` rows in which no key is cut in two.

    Each batch is looked at once, however many of them a key fills.
    """
    held: list[pa.RecordBatch] = []
    count, last = 0, None
    for b in batches:
        if not b.num_rows:
            continue
        k = ints(b[key])
        if held and count + b.num_rows >= rows:
            at = int(np.searchsorted(k, k[-1], "left"))
            if at or k[-1] != last:  # the batch's last key starts in it: all before that key is whole
                yield pa.Table.from_batches([*held, *([b.slice(0, at)] if at else [])]).combine_chunks()
                held, count, b = [], 0, b.slice(at)
        held.append(b)
        count += b.num_rows
        last = k[-1]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys starts, and its length."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    return start, np.diff(np.r_[start, len(sorted_keys)])


def give_back() -> None:
    """Returns freed memory to the system; workers and drivers live on with what they once needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps the memory for itself
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives freed memory back when a partition is done."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied
