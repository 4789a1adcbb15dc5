"""Counting the keys of many texts in bounded pieces, and bringing the counts back to the texts.

Texts go into chunks of about CHUNK_BYTES by a hash of the row.  A chunk sends every distinct key once,
with its local count, to the bucket of the key's leading bits; a bucket adds up what all chunks sent and
answers each chunk with one number for each of its keys, in order.  A key that a third of all words share
is one entry for each chunk, a source or language that holds a third of all rows is many chunks.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 6 << 20
#: Keys for each bucket, about, and the fewest buckets.
BUCKET_KEYS, LEAST_BUCKETS = 1_000_000, 32


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def chunks_of(size: int) -> int:
    """How many chunks for *size* bytes."""
    return max(1, -(-size // CHUNK_BYTES))


def buckets_of(size: int, keys_a_byte: float) -> int:
    """Binary logarithm of the number of buckets for the keys of *size* bytes of text."""
    return max(LEAST_BUCKETS, int(size * keys_a_byte / BUCKET_KEYS)).bit_length() - 1


def chunk(n: int, *of: str) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(n))


def squeeze(x: np.ndarray) -> bytes:
    """An array as compressed planes of its bytes: planes of zeros cost nothing."""
    x = np.ascontiguousarray(x)
    planes = x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes))


def unsqueeze(blob: bytes | None, kind=np.uint64) -> np.ndarray:
    kind = np.dtype(kind)
    if not blob:
        return np.zeros(0, kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def squeeze_sorted(x: np.ndarray) -> bytes:
    """Ascending numbers by their differences."""
    return squeeze(np.diff(x, prepend=np.zeros(1, x.dtype)))


def unsqueeze_sorted(blob: bytes | None) -> np.ndarray:
    return np.cumsum(unsqueeze(blob), dtype=np.uint64)


def distinct(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the whole-number weight of each, and where each key stands among them."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    at = np.flatnonzero(new)
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    total = np.add.reduceat(weight[order], at) if len(at) else np.zeros(0, weight.dtype)
    return ordered[at], total, back


def cuts(keys: np.ndarray, bits: int, width: int = 64) -> np.ndarray:
    """Where each of 2**bits buckets begins among sorted keys of *width* bits."""
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(width - bits) if bits else np.zeros(1, np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))
