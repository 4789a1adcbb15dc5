"""Sets of five-word shingles and their exact comparison, for the similarity operators.

A document's set: the 64-bit hashes of its distinct windows of five words (letters A-Z in lower
case); with fewer words the whole sequence is one shingle; without words it is empty.  A set is
named by a hash of its sorted members, so equal sets share a name and are handled once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import arrays
from panelcast.llm.tables import bit_set, share

WIDTH = 5


def whole(h: np.ndarray, salt: int) -> np.uint64:
    """One hash for a sequence shorter than a shingle."""
    return np.uint64(xxhash.xxh64_intdigest(h.tobytes(), int(salt)))


def row_sets(h: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each row."""
    s = arrays.windows(h, WIDTH)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WIDTH:
            x = np.sort(s[a : b - WIDTH + 1])
            yield x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif b > a:
            yield np.array([whole(h[a:b], b - a)], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def sets_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, name of the set, set) of each row of a text column."""
    data, at = arrays.utf8(column)
    for a, b in arrays.runs(at):
        h, first = arrays.words(data[at[a] : at[b]], at[a : b + 1] - at[a], lower=True)
        for i, x in enumerate(row_sets(h, first), a):
            yield i, xxhash.xxh64_intdigest(x) if len(x) else 0, x


def signed(values) -> np.ndarray:
    return np.asarray(values, np.uint64).view(np.int64)


def needed_sets(docs: DataFrame, names: DataFrame, text: str = "text") -> DataFrame:
    """(set_id, members) of the sets named in *names* (set_id), one row each.

    The texts are read once more and only the named sets leave the scan: a bit set of bounded size
    drops nearly all others, the join the rest.
    """
    bits = share(docs.sparkSession, bit_set(names.select("set_id"), names.count()))

    def body(batches):
        for batch in batches:
            wanted, ids, members, seen = bits.value, [], [], set()
            for _, name, x in sets_of(batch.column(0)):
                if name not in seen and len(x) and wanted.has(np.array([name], np.uint64))[0]:
                    seen.add(name)
                    ids.append(name)
                    members.append(x.tobytes())
                if len(members) >= 512:
                    yield pa.record_batch([pa.array(signed(ids)), pa.array(members, pa.binary())], ["set_id", "members"])
                    ids, members = [], []
            if ids:
                yield pa.record_batch([pa.array(signed(ids)), pa.array(members, pa.binary())], ["set_id", "members"])

    found = docs.select(text).mapInArrow(body, "set_id long, members binary")
    return found.groupBy("set_id").agg(F.first("members").alias("members")).join(names.select("set_id"), "set_id", "left_semi")


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """*pairs* (a, b: set names) with their exact common, size_a and size_b.

    Each pair carries one set through one exchange and meets the other in the join; a set with very
    many partners is a skewed key of that join, which the adaptive planner splits.
    """
    half = pairs.join(sets.select(F.col("set_id").alias("b"), F.col("members").alias("y")), "b")
    full = half.join(sets.select(F.col("set_id").alias("a"), F.col("members").alias("x")), "a")

    def body(batches):
        for batch in batches:
            a, b, x, y = (batch.column(i) for i in range(4))
            out = np.zeros((3, len(a)), np.int64)
            for i in range(len(a)):
                u, v = np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)
                out[:, i] = common(u, v), len(u), len(v)
            yield pa.record_batch([a, b, *(pa.array(o) for o in out)], ["a", "b", "common", "size_a", "size_b"])

    return full.select("a", "b", "x", "y").mapInArrow(body, "a long, b long, common long, size_a long, size_b long")


def linked(pairs: DataFrame, sets: DataFrame, percent: int = 80) -> DataFrame:
    """The pairs whose sets share *percent* of their union at least."""
    c = compared(pairs, sets)
    return c.where(100 * F.col("common") >= percent * (F.col("size_a") + F.col("size_b") - F.col("common"))).select("a", "b")
