"""Numpy over whole Arrow columns of text: words, hashes, windows and bit sets.

Nothing here loops over words in Python.  A text column is cut into runs of rows of about a
megabyte, so that memory stays bounded whatever the batch; a longer text is a run of its own and
its words are hashed piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 1 << 20
PIECE_BYTES = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTE = _odd(11, 256)
_A, _B, _C, _D = _odd(12, 4)
_R = int(_odd(13, 1)[0])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


_POW = {"up": _powers(_R, PIECE_BYTES + 1), "down": _powers(pow(_R, -1, 2**64), PIECE_BYTES + 1)}


def _power(way: str, n: int) -> np.ndarray:
    if n > len(_POW[way]):
        return _powers(_R if way == "up" else pow(_R, -1, 2**64), n)
    return _POW[way][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit hash."""
    x = x ^ (x >> np.uint64(32))
    x *= _C
    x ^= x >> np.uint64(29)
    x *= _D
    x ^= x >> np.uint64(32)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and where each row starts; a null text is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if at is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at.astype(np.int64) - int(at[0])


def runs(at: np.ndarray, limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about *limit* bytes; a longer row stands alone."""
    a, n = 0, len(at) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def _edges(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; a row's end also ends its word."""
    word = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    opens, closes = word.copy(), word.copy()
    opens[1:] &= ~word[:-1] | cut[1:-1]
    closes[:-1] &= ~word[1:] | cut[1:-1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def words(data: np.ndarray, at: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and each row's first word (and the total as a last entry)."""
    starts, ends = _edges(data, at)
    first = np.searchsorted(starts, at)
    return hashed(data, starts, ends, _BYTE[LOWER] if lower else _BYTE), first


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """A 64-bit hash of every stretch of bytes; stretches are in order and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):  # a piece ends where a stretch does
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + PIECE_BYTES, "right")))
        lo, hi = starts[a], ends[b - 1]
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[data[lo:hi]] * _power("up", hi - lo), out=total[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        out[a:b] = (total[e] - total[s]) * _power("down", hi - lo)[s] + (e - s).astype(np.uint64)
        a = b
    return mix(out)


def _joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = x * _A
    z += y * _B
    z ^= z >> np.uint64(29)
    z *= _C
    z ^= z >> np.uint64(32)
    return z


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of the *k* words from every word on; the caller masks those that cross a row's end."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, width = None, 0, h, 1
    while True:
        if k & width:
            part = power[done : done + n]
            out = part if out is None else _joined(out, part)
            done += width
        width *= 2
        if width > k:
            return out
        power = _joined(power[: -(width // 2)], power[width // 2 :])


def starts_of(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Every word at which *k* words of one row start, and that row."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + first[:-1][row], row


def spans(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


class Bits:
    """A set of 64-bit values by their low bits: may say yes too often, never no wrongly."""

    def __init__(self, body: np.ndarray):
        self.body, self.mask = body, np.uint64(len(body) * 8 - 1)

    def has(self, x: np.ndarray) -> np.ndarray:
        x = x & self.mask
        return (self.body[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 > 0


def blobs(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary column whose i-th row holds values[cuts[i]:cuts[i + 1]]."""
    values = np.ascontiguousarray(values)
    size = values.dtype.itemsize * int(np.prod(values.shape[1:]))
    at = (np.asarray(cuts, np.int64) * size).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(at), pa.py_buffer(values)])
