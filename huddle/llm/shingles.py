"""Word shingles of whole texts as 64-bit hashes, for Arrow batches.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A text's set holds its
distinct runs of ``width`` words; with fewer words, the whole sequence as one;
without words nothing.
"""

from __future__ import annotations

import numpy as np

SLICE_BYTES = 2 << 20
SLICE_ROWS = 2_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WS = np.zeros(256, bool)
_WS[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64 bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def row_slices(off: np.ndarray, limit: int = SLICE_BYTES, rows: int = SLICE_ROWS):
    """Row ranges of at most ``rows`` rows and about ``limit`` bytes (one row at least)."""
    a, n = 0, len(off) - 1
    while a < n:
        b = min(a + rows, max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1))
        yield a, b
        a = b


def words(raw: np.ndarray, off: np.ndarray, gaps: np.ndarray = _WS, prefixes: tuple[int, ...] = ()):
    """Hash, row and start of every word, and hashes of its first bytes for each length of
    ``prefixes`` (of the whole word, if shorter); ``gaps`` tells the bytes between words."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.uint64)
        return none, np.zeros(0, np.int64), np.zeros(0, np.int64), *[none for _ in prefixes]
    ws = gaps[raw]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begin = ~ws
    begin[1:] &= ws[:-1] | edge[1:-1]
    end = ~ws
    end[:-1] &= ws[1:] | edge[1:-1]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    power = np.cumprod(np.concatenate([[_U(1)], np.full(n - 1, _U(_BASE))]), dtype=np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[raw]] * power, out=total[1:])
    back = np.cumprod(np.concatenate([[_U(1)], np.full(n - 1, _U(_INVERSE))]), dtype=np.uint64)
    hashed = lambda e: mix((total[e] - total[s]) * back[s] + (e - s).astype(np.uint64))
    return hashed(e), np.searchsorted(off, s, "right") - 1, s, *[hashed(np.minimum(s + k, e)) for k in prefixes]


def sets(raw: np.ndarray, off: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all rows, sorted by row and hash, and the n+1 offsets of the rows."""
    rows = len(off) - 1
    h, row, _ = words(raw, off)
    count = np.bincount(row, minlength=rows)
    first = np.cumsum(count) - count
    odd = [_U(((2 * k + 3) * 0xD6E8FEB86659FD93) % (1 << 64) | 1) for k in range(width)]
    full = max(len(h) - width + 1, 0)
    acc = np.zeros(full, np.uint64)
    for k in range(width):
        acc += h[k:k + full] * odd[k]
    at = np.flatnonzero(row[:full] == row[width - 1:width - 1 + full]) if full else np.zeros(0, np.int64)
    out, owner = [mix(acc[at])], [row[at]]
    few = np.flatnonzero((count > 0) & (count < width))
    if len(few):
        acc = count[few].astype(np.uint64) * _U(0xA0761D6478BD642F)
        for k in range(width - 1):
            has = count[few] > k
            acc[has] += h[first[few[has]] + k] * odd[k]
        out.append(mix(acc))
        owner.append(few)
    value, owner = np.concatenate(out), np.concatenate(owner)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))]).astype(np.int64)
