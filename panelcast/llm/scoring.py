"""Scoring texts by an interpolated trigram model: deleted interpolation.

The model mixes maximum-likelihood estimates, P3 = a f(w|uv) + (1-a) P2, P2 = b f(w|v) + (1-b) P1 and
P1 = c f(w) + (1-c) / (V + 1).  The weights a and b belong to buckets of the context's frequency (powers
of two), so estimates from rare contexts count for less.

1. Texts are dealt into chunks; each chunk counts its words, pairs and triples and sends them to buckets
   (:mod:`panelcast.llm.lookup`), which return the counts over all training texts.  Words are told apart
   by 64-bit hashes.  Pairs and triples are told apart by their bucket and 40 bits more; a bucket holds
   about a million, so about one in a million shares its counter, whatever the size of the corpus.
2. A tenth of all rows, training rows of one remainder, is deleted from the counts; on those rows the
   mixture weights are learned by expectation-maximisation from the counts of the others.  A bucket's
   weight has one pseudo-observation for the lower order, so it stays below 1.
3. Every text is scored with the counts of all training rows.

Each text is preceded by two starts, which are contexts only, and closed by one end, which is a token.
Nulls: a null text is empty (its end is scored); a null doc_id counts as empty text for the remainder,
which makes it held out.  Repeated rows are rows like others.  Without training rows all words are
unknown and only the uniform part is left.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import arrays
from panelcast.llm.lookup import buckets_of, chunk, chunks_of, cuts, distinct, squeeze, squeeze_sorted, text_bytes, unsqueeze, unsqueeze_sorted
from panelcast.llm.tables import share
from panelcast.sources.tables import materialise

FOLDS, HELD_OUT, DELETED = 10, 0, 9
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
#: Bits that tell pairs and triples of one bucket apart.
REST = 40
BINS, MOST_ROUNDS, ENOUGH = 64, 25, 1e-5
_TRIPLE = np.uint64(0x9E3779B97F4A7C15)
_TEXTS = "chunk long, doc_id long, fold int, text string"
_SENT = "bucket int, chunk long, deleted boolean, words binary, n_words binary, grams binary, n_grams binary"
_COUNTS = "chunk long, bucket int, words binary, grams binary, kept_words binary, kept_grams binary, n long, v long, kept_n long"


class Sequences:
    """The tokens of a chunk's texts with their keys: words, pairs and triples."""

    def __init__(self, text: pa.Array, bits: int):
        data, at = arrays.utf8(text)
        h, first = arrays.words(data, at, lower=True)
        rows = len(text)
        row = np.arange(rows)
        x = np.full(len(h) + 3 * rows, START)
        x[np.arange(len(h)) + 3 * arrays.spans(first) + 2] = h
        self.ends = first[1:] + 3 * row + 2
        x[self.ends] = END
        self.starts = first[:-1] + 3 * row
        token = np.ones(len(x), bool)
        token[self.starts] = token[self.starts + 1] = False
        self.token = np.flatnonzero(token)  # where the predicted tokens stand
        self.first = np.append(self.starts - 2 * row, len(self.token))  # each text's first among them
        shift = np.uint64(64 - bits - REST)
        pair, triple = arrays.windows(x, 2), arrays.windows(x, 3) ^ _TRIPLE
        second = np.ones(len(x), bool)
        second[self.starts] = False
        self.paired = np.flatnonzero(second)  # pairs end at all places but a text's first
        self.words = x[self.token]
        self.grams = np.concatenate((arrays.mix(pair[self.paired - 1]) >> shift, arrays.mix(triple[self.token - 2]) >> shift))
        self.opening = self.token - 1 == np.repeat(self.starts + 1, np.diff(self.first))

    def weight(self, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For words and for grams, 1 where the text's flag is set."""
        n = np.diff(self.first)
        word = np.repeat(used.astype(np.int64), n)
        return word, np.concatenate((np.repeat(used.astype(np.int64), n + 1), word))


def _send(bits: int):
    def body(table):
        fold = table["fold"].to_numpy()
        s = Sequences(table["text"].combine_chunks(), bits)
        word_weight, gram_weight = s.weight(fold != HELD_OUT)
        words, n_words, _ = distinct(s.words, word_weight)
        grams, n_grams, _ = distinct(s.grams, gram_weight)
        a, b = cuts(words, bits), cuts(grams, bits, bits + REST)
        low = np.uint64((1 << REST) - 1)
        out = []
        for k in range(1 << bits):
            i, j = slice(a[k], a[k + 1]), slice(b[k], b[k + 1])
            if i.start < i.stop or j.start < j.stop:
                out.append((k, squeeze_sorted(words[i]), squeeze(n_words[i]), squeeze_sorted(grams[j] & low), squeeze(n_grams[j])))
        columns = list(zip(*out, strict=True))
        n = len(out)
        return pa.table(
            {
                "bucket": pa.array(columns[0], pa.int32()),
                "chunk": pa.array([table["chunk"][0].as_py()] * n, pa.int64()),
                "deleted": pa.array([bool(fold[0] == DELETED)] * n),
                **{name: pa.array(x, pa.binary()) for name, x in zip(("words", "n_words", "grams", "n_grams"), columns[1:], strict=True)},
            }
        )

    return body


def _count(table):
    """For every chunk the totals of its keys of one bucket, and the bucket's sums."""
    deleted = np.array(table["deleted"].to_pylist(), bool)
    out, sums = {"chunk": table["chunk"].to_pylist()}, []
    for name in ("words", "grams"):
        keys = [unsqueeze_sorted(x) for x in table[name].to_pylist()]
        n = np.concatenate([unsqueeze(x, np.int64) for x in table[f"n_{name}"].to_pylist()])
        size = np.array([len(x) for x in keys])
        _, total, back = distinct(np.concatenate(keys), n)
        kept = np.zeros(len(total), np.int64)
        np.add.at(kept, back, np.where(np.repeat(deleted, size), 0, n))
        ends = np.cumsum(size)
        spans = list(zip((ends - size).tolist(), ends.tolist(), strict=True))
        out[name] = [squeeze(total[back[a:b]]) for a, b in spans]
        out[f"kept_{name}"] = [squeeze(kept[back[a:b]]) if d else None for (a, b), d in zip(spans, deleted.tolist(), strict=True)]
        if name == "words":
            sums = [int(total.sum()), int((total > 0).sum()), int(kept.sum())]
    m = len(out["chunk"])
    columns = {"chunk": pa.array([*out["chunk"], -1], pa.int64()), "bucket": pa.array([table["bucket"][0].as_py()] * (m + 1), pa.int32())}
    columns |= {x: pa.array([*out[x], None], pa.binary()) for x in ("words", "grams", "kept_words", "kept_grams")}
    return pa.table(columns | {x: pa.array([None] * m + [s], pa.int64()) for x, s in zip(("n", "v", "kept_n"), sums, strict=True)})


def counts(texts: DataFrame, bits: int) -> DataFrame:
    """Rows for each chunk and bucket with the totals of its keys; chunk -1 has each bucket's sums."""
    return texts.groupBy("chunk").applyInArrow(_send(bits), _SENT).groupBy("bucket").applyInArrow(_count, _COUNTS)


def _met(table, bits: int, kept: bool):
    """The chunk's texts, their tokens and counts: triple, pair before, pair, word before, word."""
    met = table["bucket"].is_valid()
    texts, found = table.filter(pa.compute.invert(met)), table.filter(met).sort_by("bucket")
    s = Sequences(texts["text"].combine_chunks(), bits)
    totals = {}
    for name in ("words", "grams"):
        column = found[f"kept_{name}" if kept else name].to_pylist()
        totals[name] = np.concatenate([unsqueeze(x, np.int64) for x in column])
    keys, _, back = distinct(s.words, np.zeros(len(s.words), np.int64))
    word = totals["words"][back]
    end = totals["words"][np.searchsorted(keys, END)]  # as often as a text has begun
    _, _, back = distinct(s.grams, np.zeros(len(s.grams), np.int64))
    gram = totals["grams"][back]
    pair = gram[: len(s.paired)]
    triple = gram[len(s.paired) :]
    at = np.searchsorted(s.paired, s.token)  # the pair that ends at each token; the one before it is its context
    before = np.where(s.opening, end, np.concatenate((word[:1], word[:-1])))
    return texts, s, (triple, pair[at - 1], pair[at], before, word)


def _parts(c, n: int):
    """Estimates of the three orders and the buckets of their contexts."""
    triple, context, pair, before, word = c
    f3 = triple / np.maximum(context, 1)
    f2 = pair / np.maximum(before, 1)
    b3, b2 = (np.where(x > 0, np.frexp(x)[1], 0).astype(np.uint8) for x in (context, before))
    return np.minimum(f3, 1.0), np.minimum(f2, 1.0), word / max(n, 1), b3, b2


def events(texts: DataFrame, met: DataFrame, bits: int, n: int) -> DataFrame:
    """The estimates for every token of the deleted rows, by the counts without them."""

    def body(table):
        _, _, c = _met(table, bits, True)
        parts = _parts(c, n)
        return pa.table({x: pa.array([squeeze(p)], pa.binary()) for x, p in zip(("f3", "f2", "f1", "b3", "b2"), parts, strict=True)})

    return _both(texts, met.where("kept_words is not null")).applyInArrow(body, "f3 binary, f2 binary, f1 binary, b3 binary, b2 binary")


def _both(texts: DataFrame, met: DataFrame):
    columns = ("chunk", "bucket", "words", "grams", "kept_words", "kept_grams")
    return texts.unionByName(met.select(*columns), allowMissingColumns=True).groupBy("chunk")


def learned(found: DataFrame, uniform: float) -> tuple[np.ndarray, np.ndarray]:
    """The weights by expectation-maximisation: two rows by context bucket, and that of the words."""
    mixed, single = np.full((2, BINS), 0.5), 0.9
    mixed[:, 0] = 0.0
    last = None
    for _ in range(MOST_ROUNDS):
        weights = mixed.copy(), single

        def body(batches, weights=weights):
            (w3, w2), w1 = weights
            sums = np.zeros((4, BINS))
            ones = np.zeros(4)  # shares of words and of the uniform part, log-likelihood, tokens
            for batch in batches:
                for row in batch.to_pylist():
                    f3, f2, f1 = (unsqueeze(row[x], np.float64) for x in ("f3", "f2", "f1"))
                    b3, b2 = unsqueeze(row["b3"], np.uint8), unsqueeze(row["b2"], np.uint8)
                    a, b = w3[b3], w2[b2]
                    p3, p2, p1, p0 = a * f3, (1 - a) * b * f2, (1 - a) * (1 - b) * w1 * f1, (1 - a) * (1 - b) * (1 - w1) * uniform
                    p = p3 + p2 + p1 + p0
                    r3 = p3 / p
                    for i, (x, y) in enumerate(((b3, r3), (b3, np.ones(len(p))), (b2, p2 / p), (b2, 1 - r3))):
                        sums[i] += np.bincount(x, y, BINS)
                    ones += ((p1 / p).sum(), (p0 / p).sum(), np.log(p).sum(), len(p))
            rows = [*((i, j, sums[i, j]) for i in range(4) for j in range(BINS) if sums[i, j]), *((4, j, ones[j]) for j in range(4))]
            yield pa.record_batch([pa.array(x) for x in zip(*rows, strict=True)], ["level", "bin", "value"])

        got = found.mapInArrow(body, "level long, bin long, value double").groupBy("level", "bin").agg(F.sum("value").alias("value"))
        sums, ones = np.zeros((4, BINS)), np.zeros(4)
        for level, place, value in got.collect():  # 4 * BINS + 4 rows at most
            if level < 4:
                sums[level, place] = value
            else:
                ones[place] = value
        mixed = sums[[0, 2]] / (sums[[1, 3]] + 1.0)
        seen = sums[[1, 3]] > 0
        for row, met in zip(mixed, seen, strict=True):  # a bucket without tokens has its lower neighbour's weight
            for k in range(1, BINS):
                row[k] = row[k] if met[k] else row[k - 1] if k > 1 else 0.5
        mixed[:, 0] = 0.0
        single = ones[0] / (ones[0] + ones[1] + 1.0) if ones[3] else 0.9
        mean = ones[2] / ones[3] if ones[3] else 0.0
        if last is not None and mean - last < ENOUGH:
            break
        last = mean
    return mixed, np.float64(single)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of *docs*."""
    size = text_bytes(docs)
    n_chunks, bits = chunks_of(size), buckets_of(size, 0.3)
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")
    own = chunk(n_chunks, "doc_id", "text")
    less = F.lit(n_chunks) + chunk(-(-n_chunks // (FOLDS - 2)), "doc_id", "text")
    texts = docs.select(fold.alias("fold"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.select(F.when(F.col("fold") == DELETED, less).otherwise(own).cast("long").alias("chunk"), "doc_id", "fold", "text")
    met = materialise(counts(texts, bits))
    sums = met.where("chunk = -1").agg(F.sum("n"), F.sum("v"), F.sum("kept_n")).first()
    n, v, kept_n = (x or 0 for x in sums)
    found = materialise(events(texts.where(F.col("fold") == DELETED), met, bits, kept_n))
    weights = share(docs.sparkSession, learned(found, 1.0 / (v + 1)))

    def body(table):
        rows, s, c = _met(table, bits, False)
        (w3, w2), w1 = weights.value
        f3, f2, f1, b3, b2 = _parts(c, n)
        a, b = w3[b3], w2[b2]
        p = np.log10(a * f3 + (1 - a) * (b * f2 + (1 - b) * ((w1 if n else 0.0) * f1 + (1 - (w1 if n else 0.0)) / (v + 1))))
        base = np.log10((c[4] + 0.1) / (n + 0.1 * (v + 1)))
        at, held = s.first[:-1], rows["fold"].to_numpy() == HELD_OUT
        return pa.table(
            {
                "doc_id": rows["doc_id"],
                "held_out": pa.array(held),
                "n_tokens": pa.array(np.diff(s.first)),
                "n_known": pa.array(np.add.reduceat((c[4] > 0).astype(np.int64), at)),
                "train_tokens": pa.array(np.full(len(at), n)),
                "base_score": pa.array(np.add.reduceat(base, at)),
                "score": pa.array(np.add.reduceat(p, at)),
            }
        )

    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return _both(texts, met.where("chunk >= 0")).applyInArrow(body, kind)
