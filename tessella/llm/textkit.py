"""Vectorised word and byte work on Arrow string columns.

Texts of a batch stay in one byte buffer; words, windows and hashes are numpy
arrays over that buffer.  64-bit hashes stand for words and windows.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

try:
    _TRIM = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None

_RNG = np.random.Generator(np.random.PCG64(20240607))
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOW = 1 << 16
with np.errstate(over="ignore"):
    POW = np.cumprod(np.full(_LOW, 0xD6E8FEB86659FD93, np.uint64))
    POW_HIGH = np.cumprod(np.full(_LOW, 0xA0761D6478BD642F, np.uint64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = pc.fill_null(column, b"" if binary else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def release() -> None:
    """Give freed memory back to the system; workers live on between tasks of different operators."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``most`` bytes of text; one longer row makes a run of its own."""
    if not batch.num_rows:
        return
    _, at = buffers(batch.column(column))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield batch.slice(row, end - row)
        row = end


def regrouped(batches: Iterator[pa.RecordBatch], column: str, least: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows in runs of ``least`` to ``most`` bytes of text where the rows allow it."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part in slices(batch, column, most):
            held.append(part)
            at = buffers(part.column(column))[1]
            size += int(at[-1]) + 64 * part.num_rows
            if size >= least:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
        del batch
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    release()


def range_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the disjoint, ascending byte ranges; empty ranges are not allowed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    begin = np.cumsum(lengths) - lengths
    total = int(lengths.sum())
    kind = np.int32 if max(total, len(data)) < 2**31 else np.int64
    place = np.arange(total, dtype=kind)
    place -= np.repeat(begin.astype(kind), lengths)
    if total == len(data):
        value = BYTE[data]
    else:
        value = BYTE[data[place + np.repeat(starts.astype(kind), lengths)]]
    if int(lengths.max()) > _LOW:
        value *= POW_HIGH[(place >> 16) & (_LOW - 1)]
        place &= _LOW - 1
    value *= POW[place]
    return mix(np.add.reduceat(value, begin) + lengths.astype(np.uint64) * _ODD)


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, words before each row and after the last) of the runs without space, tab, LF, VT, FF or CR."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    full = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    first = full.copy()
    first[1:] &= ~full[:-1] | edge[1:-1]
    last = full.copy()
    last[:-1] &= ~full[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1 - starts, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, at: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, length, bounds) of the words of each row; ``lower`` folds A-Z."""
    if lower:
        data = LOWER[data]
    starts, lengths, bounds = words(data, at)
    return range_hashes(data, starts, lengths), starts, lengths, bounds


def ngrams(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` words inside each row, and their bounds."""
    total = len(hashes)
    counts = np.maximum(np.diff(bounds) - (n - 1), 0)
    out_bounds = np.concatenate([[0], np.cumsum(counts)])
    if total < n:
        return np.zeros(0, np.uint64), out_bounds
    out = hashes[: total - n + 1] * POW[1]
    for k in range(1, n):
        out = mix(out + POW[k + 1] * hashes[k : total - n + 1 + k])
    keep = np.zeros(total + 1, np.int32)
    some = counts > 0
    np.add.at(keep, bounds[:-1][some], 1)
    np.add.at(keep, bounds[:-1][some] + counts[some], -1)
    return out[np.cumsum(keep)[: total - n + 1] > 0], out_bounds


def sliding_argmin(keys: np.ndarray, w: int) -> np.ndarray:
    """Where the leftmost least key of each window of ``w`` keys lies; keys are cut to their upper 32 bits."""
    n = len(keys)
    if n < w:
        return np.zeros(0, np.int64)
    packed = (keys & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // w)
    grid = np.full(blocks * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    grid[:n] = packed
    grid = grid.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(behind[: n - w + 1], ahead[w - 1 : n])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
