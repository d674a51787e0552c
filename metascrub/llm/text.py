"""Vectorised word, window and minimum hashes over the bytes of Arrow string columns.

All hashes are 64-bit and depend on content alone, so equal text has equal hashes in every task and run.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE = 3 << 20  #: bytes of text handled at once, so that a task's arrays stay small
BASE = np.uint64(0x9E3779B97F4A7C15)
WORD_BASE = np.uint64(0xD6E8FEB86659FD93)

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII but letters and digits separates words.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE to the 0th, 1st, ... power; n of them at least."""
    global _powers
    if len(_powers) < n:
        steps = np.full(1 << (n - 1).bit_length(), BASE, np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def row_key(*columns: str) -> Column:
    """A 64-bit hash of a row's values; a null is not what is left out, so it differs from all other places of one."""
    return F.xxhash64(*columns, *[F.col(c).isNull() for c in columns])


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows, one after the other, and where each row starts (one more at the end)."""
    column = pc.fill_null(column, "") if column.null_count else column
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.empty(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``most`` bytes in the column, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        total, start = np.cumsum(sizes), 0
        while start < len(sizes):
            before = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, before + most, "right")))
            yield batch.slice(start, end - start)
            start = end


def words(data: np.ndarray, at: np.ndarray, apart: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all rows: first byte, end, hash; and the number of words before each row (one more at the end)."""
    inside = ~apart[data]
    if not inside.any():
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64), np.zeros(len(at), np.int64)
    row_starts = at[:-1][at[:-1] < len(data)]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[row_starts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[row_starts[row_starts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    value = data[inside].astype(np.uint64) + np.uint64(1)
    value *= powers(int(lengths.max()) + 1)[place]
    hashes = mix(np.add.reduceat(value, first) + lengths.astype(np.uint64) * WORD_BASE)
    return starts, ends, hashes, np.searchsorted(starts, at)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """A polynomial hash of each run of n values, from runs of 1, 2, 4, ... values."""
    if len(h) < n or n < 1:
        return np.empty(0, np.uint64)
    whole, width, run, size = None, 0, h, 1
    times = np.array([WORD_BASE])
    while True:
        if n & size:
            if whole is None:
                whole, width = run, size
            else:
                m = min(len(whole), len(run) - width)
                whole, width = whole[:m] * times + run[width : width + m], width + size
        if size * 2 > n:
            return whole
        run = run[: len(run) - size] * times + run[size:]
        size, times = size * 2, times * times


def lowest(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each n values that follow each other."""
    if len(values) < n:
        return np.empty(0, values.dtype)
    blocks = -(-len(values) // n)
    padded = np.full(blocks * n, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, n)
    left = np.minimum.accumulate(grid, 1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    m = len(values) - n + 1
    return np.minimum(right[:m], left[n - 1 : n - 1 + m])


def runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of each run of true values."""
    edge = np.diff(np.concatenate(([0], marks.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def covered(length: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``length`` places lie in one of the spans."""
    edge = np.bincount(starts, minlength=length + 1)[: length + 1] - np.bincount(ends, minlength=length + 1)[: length + 1]
    return np.cumsum(edge)[:length] > 0
