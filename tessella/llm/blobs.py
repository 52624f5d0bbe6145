"""Arrays packed into binary columns, so that a shuffle moves one row for a whole block of numbers."""

from __future__ import annotations

import numpy as np


def packed(values: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def unpacked(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of unsigned numbers, byte planes apart."""
    return packed(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)


def planes_back(data: bytes, width: int) -> np.ndarray:
    raw = unpacked(data, np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return out.view("<u8").reshape(-1)


def ascending(values: np.ndarray) -> bytes:
    """Sorted numbers as differences."""
    return planes(np.diff(values.astype("<u8"), prepend=np.uint64(0)), 8)


def ascending_back(data: bytes) -> np.ndarray:
    return np.cumsum(planes_back(data, 8), dtype=np.uint64)


def counts_out(values: np.ndarray, width: int = 4) -> bytes:
    return planes(values, width)


def counts_back(data: bytes, width: int = 4) -> np.ndarray:
    return planes_back(data, width).astype(np.int64)
