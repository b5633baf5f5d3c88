"""Whole numbers in as few bytes as they need: seven bits a byte, the top bit says that more follow."""

from __future__ import annotations

import numpy as np


def pack(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bytes of non-negative numbers, and where each number's bytes end."""
    v = values.astype(np.uint64)
    sizes = np.ones(len(v), np.int64)
    for bits in range(7, 64, 7):
        more = v >> np.uint64(bits) > 0
        if not more.any():
            break
        sizes += more
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(v) else 0, np.uint8)
    starts = ends - sizes
    for k in range(int(sizes.max()) if len(v) else 0):
        own = np.flatnonzero(sizes > k)
        low = (v[own] >> np.uint64(7 * k)).astype(np.uint8) & 127
        out[starts[own] + k] = low | np.where(sizes[own] > k + 1, 128, 0).astype(np.uint8)
    return out.tobytes(), ends


def unpack(data: bytes | np.ndarray) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8) if isinstance(data, (bytes, bytearray, memoryview)) else data
    ends = np.flatnonzero(raw < 128)
    if not len(ends):
        return np.empty(0, np.int64)
    starts = np.concatenate(([0], ends[:-1] + 1))
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts)


def gaps(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Steps between rising numbers; the first of each list, at ``firsts``, stays whole."""
    out = np.diff(values, prepend=0)
    out[firsts] = values[firsts]
    return out


def undo_gaps(steps: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.cumsum(steps)
    return total - np.repeat(total[firsts] - steps[firsts], sizes)
