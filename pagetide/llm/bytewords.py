"""Vectorized words of Arrow text columns: boundaries and 64-bit hashes by numpy over UTF-8 bytes.

A word is a maximal run of bytes other than space and 0x09-0x0D, which in UTF-8 never
occur inside another character. A-Z are lower-cased first. A word's hash is a polynomial
over a random byte table, mod 2**64, taken from differences of one running sum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_MASK = (1 << 64) - 1
_ROOT = 0x9E3779B97F4A7C15
_INVERSE = pow(_ROOT, -1, 1 << 64)
_TABLE = np.random.default_rng(20240607).integers(0, 1 << 64, 256, dtype=_U, endpoint=False)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INK = np.ones(256, dtype=bool)
_INK[[32, 9, 10, 11, 12, 13]] = False
_WINDOW = 1 << 20
_POWERS: dict[str, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    held = _POWERS.get(str(base))
    if held is None or len(held) < n:
        held = np.full(max(n, _WINDOW + 4096), base, dtype=_U)
        held[0] = 1
        np.multiply.accumulate(held, out=held)
        _POWERS[str(base)] = held
    return held[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    h = (h ^ (h >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    lo, hi = int(off[0]), int(off[-1])
    data = np.frombuffer(data, dtype=np.uint8)[lo:hi] if hi > lo else np.empty(0, np.uint8)
    return data, off - lo


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word in order, and for each row the index of its first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    ink = _INK[data]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    cuts = off[(off > 0) & (off < n)]
    first[cuts] = ink[cuts]
    last[cuts - 1] = ink[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(start), _U)
    i = 0
    while i < len(start):
        lo = start[i]
        j = max(i + 1, int(np.searchsorted(end, lo + _WINDOW, "right")))
        hi = end[j - 1]
        total = np.zeros(hi - lo + 1, _U)
        np.cumsum(_TABLE[_LOWER[data[lo:hi]]] * _powers(_ROOT, hi - lo), out=total[1:])
        out[i:j] = (total[end[i:j] - lo] - total[start[i:j] - lo]) * _powers(_INVERSE, hi - lo)[start[i:j] - lo]
        i = j
    return mix(out + (end - start).astype(_U)), start, end, np.searchsorted(start, off)
