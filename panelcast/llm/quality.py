"""Quality rules: an isolation forest on rule statistics.

Every row gets its rule statistics over the whole text: counts of words, symbols, repeated lines and
words in repeated windows, and rates made of them.  Rows that fail a base rule go.  The others are
scored by an isolation forest: trees of random splits over a few rows each; rows that stand alone
reach a leaf after few splits, and the shorter the mean path, the higher the score.

The forest is fitted on a bounded sample: labelled rows that pass the base rules, FIT_ROWS at most,
the first by a hash of doc_id.  The threshold covers all labelled rows: of the score's bins, the one
from which on dropping removes most bad rows while at most *spare* of the good rows go.

Nulls and empty texts: no words, so the base rule fails.  A null or missing label counts for
nothing; without any label of both kinds nothing is dropped by score.  Repeated rows get equal
verdicts.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import arrays
from panelcast.llm.tables import share
from panelcast.sources.tables import materialise

FIT_ROWS, TREES, SAMPLE = 8192, 100, 256
#: Bins of the score and the part of the good labelled rows that the threshold may drop.
BINS, SPARE = 1000, 0.002
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_KIND = {
    "upper": np.isin(np.arange(256), np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)),
    "shout": np.isin(np.arange(256), np.frombuffer(b"!", np.uint8)),
}
_START = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rules: how far a rate a character goes beyond what ordinary prose has; 0 for prose itself, so that
#: a short text is not an outlier by chance.
ALLOWED = {"symbols": 0.05, "upper": 0.2, "shout": 0.03}
RATES = tuple(ALLOWED)


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[at[1:]] - total[at[:-1]]


def _repeated(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words of each row that lie in a window found twice or more in the row."""
    start, row = arrays.starts_of(first, WINDOW)
    if not len(start):
        return np.zeros(len(first) - 1, np.int64)
    key = arrays.mix(arrays.windows(h, WINDOW)[start] ^ arrays.mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    step = np.zeros(len(h) + 1, np.int64)
    at = start[twice]
    step[at] += 1
    np.subtract.at(step, at + WINDOW, 1)
    return _sums(np.cumsum(step[:-1]) > 0, first)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the COUNTS and the RATES of every row, in one pass over the texts."""

    def body(batches):
        for batch in batches:
            data, at = arrays.utf8(batch.column(1))
            for a, b in arrays.runs(at):
                raw, cut = data[at[a] : at[b]], at[a : b + 1] - at[a]
                h, first = arrays.words(raw, cut)
                points = _START[raw]
                chars = _sums(points & ~arrays.SPACE[raw], cut)
                symbols, repeated = _sums(_SYMBOL[raw], cut), _repeated(h, first)
                body_, dup = raw.tobytes(), np.zeros(b - a, np.int64)
                for i, (s, e) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                    full = [x for x in body_[s:e].split(b"\n") if x.strip()]
                    dup[i] = len(full) - len(set(full))
                found = {"symbols": symbols} | {k: _sums(t[raw], cut) for k, t in _KIND.items()}
                rates = [np.maximum(found[k] / np.maximum(chars, 1) - most, 0.0) for k, most in ALLOWED.items()]
                yield pa.record_batch(
                    [batch.column(0).slice(a, b - a), *(pa.array(x.astype(np.int64)) for x in (np.diff(first), chars, symbols, dup, repeated)), *(pa.array(x.astype(float)) for x in rates)],
                    ["doc_id", *COUNTS, *RATES],
                )

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in RATES)
    return docs.select("doc_id", "text").mapInArrow(body, schema)


class Forest:
    """Isolation trees in flat arrays: at node i, values of column[i] below cut[i] go to 2i + 1."""

    def __init__(self, rows: np.ndarray, seed: int = 7, trees: int = TREES, sample: int = SAMPLE):
        rng = np.random.default_rng(seed)
        self.sample = min(sample, len(rows))
        self.depth = max(1, int(np.ceil(np.log2(max(self.sample, 2)))))
        nodes = 2 ** (self.depth + 1) - 1
        self.column = np.full((trees, nodes), -1, np.int16)
        self.cut = np.zeros((trees, nodes))
        self.length = np.zeros((trees, nodes))
        for t in range(trees):
            own = {0: rows[rng.choice(len(rows), self.sample, replace=False)]} if len(rows) else {}
            for i in range(nodes):
                part = own.pop(i, None)
                if part is None:
                    continue
                level = int(np.log2(i + 1))
                self.length[t, i] = level + _mean_path(len(part))
                spread = np.flatnonzero(part.max(0) > part.min(0)) if len(part) > 1 else []
                if level < self.depth and len(spread):
                    c = rng.choice(spread)
                    self.column[t, i], self.cut[t, i] = c, rng.uniform(part[:, c].min(), part[:, c].max())
                    low = part[:, c] < self.cut[t, i]
                    own[2 * i + 1], own[2 * i + 2] = part[low], part[~low]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for column, cut, length in zip(self.column, self.cut, self.length, strict=True):
            at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
            for _ in range(self.depth):
                c = column[at]
                at = np.where(c < 0, at, 2 * at + 2 - (x[rows, c] < cut[at]))
            total += length[at]
        return 2.0 ** -(total / len(self.column) / max(_mean_path(self.sample), 1e-9))


def _mean_path(n: int) -> float:
    """Mean path of a search that fails in a tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def assess(docs: DataFrame, labels: DataFrame, spare: float = SPARE) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept and score of every row of *docs*."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    stats = materialise(statistics(docs).withColumn("base_failed", failed))
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = stats.where("not base_failed").join(marks, "doc_id")
    fit = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS).select(*RATES).toPandas()
    forest = share(docs.sparkSession, Forest(fit.to_numpy(float)))

    def body(batches):
        for batch in batches:
            x = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in RATES], axis=1)
            keep = [c for c in batch.schema.names if c not in RATES]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.record_batch([*columns, pa.array(forest.value.score(x))], [*keep, "score"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double"
    scored = materialise(stats.mapInArrow(body, schema))
    cell = F.floor(F.col("score") * BINS).cast("int").alias("bin")
    bins = scored.where("not base_failed").join(marks, "doc_id").groupBy(cell).agg(
        F.sum((F.col("quality") == 1).cast("long")).alias("good"), F.sum((F.col("quality") == 0).cast("long")).alias("bad")
    )
    limit = _threshold(bins.collect(), spare)  # BINS rows at most
    kept = ~F.col("base_failed") & (F.floor(F.col("score") * BINS) < F.lit(limit))
    return scored.select("doc_id", *COUNTS, "base_failed", kept.alias("kept"), "score")


def _threshold(bins, spare: float) -> int:
    good, bad = np.zeros(BINS + 2), np.zeros(BINS + 2)
    for b, g, x in bins:
        good[b], bad[b] = g, x
    if not good.sum() or not bad.sum():
        return BINS + 1
    lost, caught = np.cumsum(good[::-1])[::-1], np.cumsum(bad[::-1])[::-1]
    ok = lost <= spare * good.sum()
    return int(np.flatnonzero(ok & (caught == caught[ok].max()))[-1]) if caught[ok].max() > 0 else BINS + 1
