"""Phrase collocations by language, counted in mergeable quotient filters.

1. Chunks of texts (:mod:`panelcast.llm.lookup`) send their distinct words of each language to buckets.
   A word with LEAST occurrences or more gets a whole-number id, and the chunks get the ids back.  A
   phrase with so many occurrences has only such words, so all else is left behind.
2. Counting quotient filters: the ids of a phrase are packed into a number, which an invertible Feistel
   network permutes.  Its leading bits are the bucket, the next ones the slot (the quotient), of which
   only the number of entries is kept, and all further bits are the remainder, kept in full beside a
   counter.  Nothing is lost: slot, remainder and bucket give the number back, and its inverse the ids.
   The filters that the chunks send to a bucket are sorted; merging adds the counters of equal entries.
3. Pairs are counted first.  Longer phrases are counted where all their pairs are frequent; a bit set of
   bounded size tells most others, the counters all.
4. Cuts, containment and ranks are joins and aggregates over the phrases that are left.

A word or phrase that a third of all rows hold is one entry of each chunk.  Nulls: a null text is empty,
a null lang is `und`.  Repeated rows count like others, very long texts are whole in one chunk, an empty
table gives an empty result.  Words are told apart by 64-bit hashes with their language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm import arrays
from panelcast.llm.lookup import buckets_of, chunk, chunks_of, cuts, distinct, squeeze, squeeze_sorted, text_bytes, unsqueeze, unsqueeze_sorted
from panelcast.llm.tables import bit_set, share
from panelcast.sources.tables import materialise

LEAST, LONGEST, TOP = 100, 5, 2000
#: Grams that a task gathers before it sends a filter.
FLUSH = 3_000_000
SALTS = 64
_GAP, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_GAP[[9, 32]] = True
_BREAK[[*b".,;:!?", *range(10, 14)]] = True
_ROUNDS = 4
_KEYS = arrays._odd(61, 64)
_WORDS = "bucket int, chunk long, keys binary, n binary, words binary, langs array<string>, lang_of binary"
_RANKS = "chunk long, bucket int, ranks binary, rank int, lang string, word string, f long"
_FILTER = "bucket int, k int, slots binary, remainders binary, tail binary, counters binary"


class Words:
    """The words of a chunk's texts: hashes with their language, and which are followed in their piece."""

    def __init__(self, lang: pa.Array, text: pa.Array):
        data, at = arrays.utf8(text)
        self.data = arrays.LOWER[data]
        word = ~(_GAP | _BREAK)[self.data]
        cut = np.zeros(len(data) + 1, bool)
        cut[at] = True
        opens, closes = word.copy(), word.copy()
        opens[1:] &= ~word[:-1] | cut[1:-1]
        closes[:-1] &= ~word[1:] | cut[1:-1]
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        row = np.searchsorted(at, self.starts, "right") - 1
        broken = np.concatenate(([0], np.cumsum(_BREAK[self.data])))
        self.followed = np.zeros(len(row), bool)
        self.followed[:-1] = (row[1:] == row[:-1]) & (broken[self.starts[1:]] == broken[self.ends[:-1]])
        coded = lang.dictionary_encode()
        self.langs = coded.dictionary.to_pylist()
        self.lang = coded.indices.to_numpy(zero_copy_only=False)[row]
        salt = np.array([xxhash.xxh64_intdigest(x) for x in self.langs], np.uint64)
        self.keys = arrays.mix(arrays.hashed(self.data, self.starts, self.ends) ^ salt[self.lang]) if len(row) else np.zeros(0, np.uint64)


def _send_words(bits: int):
    def body(table):
        w = Words(table["lang"].combine_chunks(), table["text"].combine_chunks())
        order = np.argsort(w.keys)
        keys = w.keys[order]
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        n, first, keys = np.diff(np.append(at, len(order))), order[at], keys[at]
        raw, edges, out = w.data.tobytes(), cuts(keys, bits), []
        for k in range(1 << bits):
            i = slice(edges[k], edges[k + 1])
            if i.start < i.stop:
                words = b"\n".join(raw[a:b] for a, b in zip(w.starts[first[i]].tolist(), w.ends[first[i]].tolist(), strict=True))
                out.append((k, squeeze_sorted(keys[i]), squeeze(n[i]), zstandard.ZstdCompressor(level=1).compress(words), squeeze(w.lang[first[i]].astype(np.uint32))))
        bucket, key, n, words, lang = zip(*out, strict=True) if out else [[]] * 5
        m = len(out)
        return pa.table(
            {
                "bucket": pa.array(bucket, pa.int32()),
                "chunk": pa.array([table["chunk"][0].as_py()] * m, pa.int64()),
                "keys": pa.array(key, pa.binary()),
                "n": pa.array(n, pa.binary()),
                "words": pa.array(words, pa.binary()),
                "langs": pa.array([w.langs] * m, pa.list_(pa.string())),
                "lang_of": pa.array(lang, pa.binary()),
            }
        )

    return body


def _rank_words(least: int):
    """Ranks of a bucket's frequent words for every chunk, these words, and the words of each language."""

    def body(table):
        keys = [unsqueeze_sorted(x) for x in table["keys"].to_pylist()]
        size = np.array([len(x) for x in keys])
        n = np.concatenate([unsqueeze(x, np.int64) for x in table["n"].to_pylist()])
        names = table["langs"].to_pylist()
        codes = {x: i for i, x in enumerate(sorted({y for x in names for y in x}))}
        lang = np.concatenate(
            [np.array([codes[y] for y in own])[unsqueeze(x, np.uint32)] for own, x in zip(names, table["lang_of"].to_pylist(), strict=True)]
        )
        whole = np.concatenate(keys)
        _, total, back = distinct(whole, n)
        often = total >= least
        rank = np.where(often, np.cumsum(often), 0)
        ends = np.cumsum(size)
        _, first = np.unique(back, return_index=True)
        first = first[often]  # where each frequent word is met first
        part = np.searchsorted(ends, first, "right")
        found, texts = [], {}
        for i, p in zip(first.tolist(), part.tolist(), strict=True):
            if p not in texts:
                texts = {p: zstandard.ZstdDecompressor().decompress(table["words"][p].as_py()).split(b"\n")} if len(texts) > 8 else texts
                if p not in texts:
                    texts[p] = zstandard.ZstdDecompressor().decompress(table["words"][p].as_py()).split(b"\n")
            found.append(texts[p][i - (ends[p] - size[p])].decode())
        by = np.bincount(lang, n, len(codes)).astype(np.int64)
        all_langs = list(codes)
        m, f = len(size), len(found)
        none = lambda k: [None] * k
        kinds = table["chunk"].to_pylist() + none(f + len(by))
        return pa.table(
            {
                "chunk": pa.array(kinds, pa.int64()),
                "bucket": pa.array([table["bucket"][0].as_py()] * len(kinds), pa.int32()),
                "ranks": pa.array([squeeze(rank[back[b - s : b]].astype(np.uint32)) for s, b in zip(size.tolist(), ends.tolist(), strict=True)] + none(f + len(by)), pa.binary()),
                "rank": pa.array(none(m) + list(range(1, f + 1)) + none(len(by)), pa.int32()),
                "lang": pa.array(none(m) + [all_langs[k] for k in lang[first].tolist()] + all_langs, pa.string()),
                "word": pa.array(none(m) + found + none(len(by)), pa.string()),
                "f": pa.array(none(m) + total[often].tolist() + by.tolist(), pa.int64()),
            }
        )

    return body


class Packing:
    """How the ids of phrases of *k* words are packed into limbs, and the permutation of these."""

    def __init__(self, k: int, width: int):
        self.k, self.width = k, width
        per = min(64 // width, -(-k // 2))
        self.split = [min(per, k - a) for a in range(0, k, per)]
        self.bits = [n * width for n in self.split]
        self.mask = [np.uint64((1 << b) - 1) for b in self.bits]

    def _round(self, limbs: list, i: int, t: int) -> None:
        others = sum((x * _KEYS[j] for j, x in enumerate(limbs) if j != i), _KEYS[8 * t + i + 8])
        limbs[i] = limbs[i] ^ (arrays.mix(others) & self.mask[i])

    def permuted(self, ids: np.ndarray) -> list[np.ndarray]:
        """Limbs of the rows of *ids* (k rows of ids)."""
        limbs, a = [], 0
        for n in self.split:
            x = np.zeros(ids.shape[1], np.uint64)
            for row in ids[a : a + n]:
                x = (x << np.uint64(self.width)) | row
            limbs.append(x)
            a += n
        for t in range(_ROUNDS):
            for i in range(len(limbs)):
                self._round(limbs, i, t)
        return limbs

    def ids(self, limbs: list[np.ndarray]) -> np.ndarray:
        """The inverse of :meth:`permuted`."""
        limbs, out = list(limbs), []
        for t in reversed(range(_ROUNDS)):
            for i in reversed(range(len(limbs))):
                self._round(limbs, i, t)
        for n, x in zip(self.split, limbs, strict=True):
            out += [(x >> np.uint64(self.width * j)) & np.uint64((1 << self.width) - 1) for j in reversed(range(n))]
        return np.stack(out)

    def added(self, limbs: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Sorted distinct entries with their counters added."""
        if sum(self.bits) <= 64:
            x = limbs[0]
            for b, y in zip(self.bits[1:], limbs[1:], strict=True):
                x = (x << np.uint64(b)) | y
            order = np.argsort(x, kind="stable")
        else:
            order = np.lexsort(limbs[::-1])
        limbs = [x[order] for x in limbs]
        new = np.ones(len(order), bool)
        new[1:] = np.any([x[1:] != x[:-1] for x in limbs], axis=0)
        at = np.flatnonzero(new)
        return [x[at] for x in limbs], np.add.reduceat(n[order], at) if len(at) else n[:0]

    def filters(self, limbs: list[np.ndarray], n: np.ndarray, bits: int):
        """(bucket, slots, remainders, tail, counters) of the filter of each bucket that has entries."""
        edges = cuts(limbs[0], bits, self.bits[0])
        for k in range(1 << bits):
            a, b = edges[k], edges[k + 1]
            if a < b:
                rest = self.bits[0] - bits
                low = limbs[0][a:b] & np.uint64((1 << rest) - 1)
                slot = min(rest, int(b - a).bit_length() - 1)
                slots = np.bincount((low >> np.uint64(rest - slot)).astype(np.int64), minlength=1 << slot)
                remainder = low & np.uint64((1 << (rest - slot)) - 1)
                yield k, squeeze(slots), squeeze(remainder), squeeze(np.concatenate([x[a:b] for x in limbs[1:]])), squeeze(n[a:b])

    def opened(self, bucket: int, bits: int, slots: bytes, remainders: bytes, tail: bytes, counters: bytes):
        """The entries and counters of a filter."""
        per, low = unsqueeze(slots, np.int64), unsqueeze(remainders)
        rest = self.bits[0] - bits
        slot = len(per).bit_length() - 1
        first = np.repeat(np.arange(len(per)), per).astype(np.uint64) << np.uint64(rest - slot)
        others = unsqueeze(tail).reshape(len(self.bits) - 1, -1)
        return [low | first | np.uint64(bucket << rest), *others], unsqueeze(counters, np.int64)


def _filter_batch(rows: list, k: list) -> pa.RecordBatch:
    bucket, *blobs = zip(*rows, strict=True) if rows else [[]] * 5
    names = ("slots", "remainders", "tail", "counters")
    return pa.record_batch(
        {"bucket": pa.array(bucket, pa.int32()), "k": pa.array(k, pa.int32())} | {x: pa.array(y, pa.binary()) for x, y in zip(names, blobs, strict=True)}
    )


def sequences(texts: DataFrame, met: DataFrame, word_bits: int, rank_bits: int, width: int, bits: int) -> DataFrame:
    """For each chunk the ids of its frequent words that stand beside others, and its filters of pairs."""

    def body(table):
        known = table["bucket"].is_valid()
        rows, ranks = table.filter(pa.compute.invert(known)), table.filter(known).sort_by("bucket")
        w = Words(rows["lang"].combine_chunks(), rows["text"].combine_chunks())
        keys, _, back = distinct(w.keys, np.zeros(len(w.keys), np.int64))
        rank = np.concatenate([np.zeros(0, np.uint32), *(unsqueeze(x, np.uint32) for x in ranks["ranks"].to_pylist())]).astype(np.uint64)
        bucket = keys >> np.uint64(64 - word_bits)
        number = ((bucket << np.uint64(rank_bits)) | (rank - np.uint64(1)))[back]
        often = (rank > 0)[back]
        link = w.followed & often
        link[:-1] &= often[1:]
        p = Packing(2, width)
        i = np.flatnonzero(link)
        limbs, n = p.added(p.permuted(np.stack((number[i], number[i + 1]))), np.ones(len(i), np.int64))
        found = list(p.filters(limbs, n, bits))
        beside = link.copy()
        beside[1:] |= link[:-1]
        out = pa.Table.from_batches([_filter_batch(found, [2] * len(found))])
        payload = pa.table({"ids": pa.array([squeeze(number[beside])], pa.binary()), "links": pa.array([squeeze(link[beside].astype(np.uint8))], pa.binary())})
        return pa.concat_tables([out, payload], promote_options="default").select(["bucket", "k", "slots", "remainders", "tail", "counters", "ids", "links"])

    both = texts.unionByName(met.select("chunk", "bucket", "ranks"), allowMissingColumns=True)
    return both.groupBy("chunk").applyInArrow(body, f"{_FILTER}, ids binary, links binary")


def longer(parts: DataFrame, pair_bits, width: int, bits: int) -> DataFrame:
    """Filters of the phrases of three to LONGEST words all of whose pairs may be frequent."""

    def body(batches):
        held, n = {k: [] for k in range(3, LONGEST + 1)}, 0

        def sent():
            rows, sizes = [], []
            for k, x in held.items():
                if x:
                    p = Packing(k, width)
                    one = np.concatenate(x, axis=1)
                    found = list(p.filters(*p.added(p.permuted(one), np.ones(one.shape[1], np.int64)), bits))
                    rows += found
                    sizes += [k] * len(found)
                    x.clear()
            return _filter_batch(rows, sizes)

        for batch in batches:
            for ids, links in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                number, link = unsqueeze(ids), unsqueeze(links, np.uint8) > 0
                if not len(number):
                    continue
                link[:-1] &= pair_bits.value.has(pair_name(number[:-1], number[1:]))
                run = link.copy()
                for k in range(3, LONGEST + 1):
                    run = run[:-1] & link[k - 2 :]  # k words from here on hang together
                    i = np.flatnonzero(run)
                    if len(i):
                        held[k].append(np.stack([number[i + j] for j in range(k)]))
                        n += len(i)
                if n >= FLUSH:
                    yield sent()
                    n = 0
        if n:
            yield sent()

    return parts.select("ids", "links").mapInArrow(body, _FILTER)


def pair_name(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return arrays.mix(a * _KEYS[0] + b)


def _merged(least: int, width: int, bits: int):
    """The phrases of a bucket's merged filters with *least* occurrences or more."""

    def body(table):
        k = table["k"][0].as_py()
        p = Packing(k, width)
        names = ("bucket", "slots", "remainders", "tail", "counters")
        parts = [p.opened(r[0], bits, *r[1:]) for r in zip(*(table[x].to_pylist() for x in names), strict=True)]
        limbs = [np.concatenate(x) for x in zip(*(x for x, _ in parts), strict=True)]
        limbs, n = p.added(limbs, np.concatenate([x for _, x in parts]))
        often = n >= least
        ids = p.ids([x[often] for x in limbs]).astype(np.int64)
        at = np.arange(ids.shape[1] + 1, dtype=np.int32) * k
        return pa.table({"p": pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(ids.T).reshape(-1))), "f": pa.array(n[often])})

    return body


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent phrases (p: ids, f), their words (id, lang, word, f), and the languages (lang, n)."""
    spark, size = docs.sparkSession, text_bytes(docs)
    word_bits = buckets_of(size, 0.03)
    texts = docs.select(
        chunk(chunks_of(size), "doc_id", "text").cast("long").alias("chunk"),
        F.coalesce("lang", F.lit("und")).alias("lang"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    met = texts.groupBy("chunk").applyInArrow(_send_words(word_bits), _WORDS).groupBy("bucket").applyInArrow(_rank_words(least), _RANKS)
    met = materialise(met)
    rank_bits = int(met.agg(F.max("rank")).first()[0] or 1).bit_length()
    width = max(16, word_bits + rank_bits)
    bits = min(buckets_of(size, 0.1), width)
    number = F.shiftleft(F.col("bucket").cast("long"), rank_bits) + F.col("rank") - 1
    words = met.where("rank is not null").select(number.alias("id"), "lang", "word", "f")
    langs = met.where("chunk is null and rank is null").groupBy("lang").agg(F.sum("f").alias("n"))
    parts = materialise(sequences(texts, met.where("chunk is not null"), word_bits, rank_bits, width, bits))
    kind = "p array<long>, f long"
    pairs = materialise(parts.where("k is not null").drop("ids", "links").groupBy("bucket", "k").applyInArrow(_merged(least, width, bits), kind))

    def named(batches):
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy().astype(np.uint64)
            yield pa.record_batch([pa.array(pair_name(flat[::2], flat[1::2]).view(np.int64))], ["x"])

    pair_bits = share(spark, bit_set(pairs.select("p").mapInArrow(named, "x long"), pairs.count()))
    sent = longer(parts.where("ids is not null"), pair_bits, width, bits)
    more = materialise(sent.groupBy("bucket", "k").applyInArrow(_merged(least, width, bits), kind))
    return pairs.union(more), words, langs


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first *top* phrases of each language."""
    phrases, words, langs = frequent_phrases(docs, least)
    counts = words.select(F.array("id").alias("p"), "f").union(phrases)
    cut = phrases.select("p", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("j"))
    cut = cut.select("p", "a", "j", F.slice("p", F.lit(1), F.col("j")).alias("left"), F.slice("p", F.col("j") + 1, F.size("p")).alias("right"))
    cut = cut.join(counts.select(F.col("p").alias("left"), F.col("f").alias("l")), "left")
    cut = cut.join(counts.select(F.col("p").alias("right"), F.col("f").alias("r")), "right")
    of = words.join(langs, "lang").select(F.col("id").alias("head"), "lang", "n")
    cut = cut.withColumn("head", F.element_at("p", 1)).join(of, "head")
    score = F.expr("(cast(a as decimal(17, 0)) * cast(n as decimal(16, 0)) * 1000) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))")
    least_cut = F.min(F.struct(score.alias("score"), "j", "l", "r")).alias("x")
    rows = cut.groupBy("p").agg(least_cut, *(F.first(c).alias(c) for c in ("a", "lang", "n")))
    size = F.size("p")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.slice("p", i, k))))
    within = phrases.where(size > 2).select(F.explode(inner).alias("p"), "f").groupBy("p").agg(F.max("f").alias("most"))
    rows = rows.join(within, "p", "left").where("most is null or most < a").drop("most")
    spelled = rows.select("p", F.posexplode("p").alias("at", "id")).join(words.select("id", "word"), "id")
    spelled = spelled.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    spelled = spelled.select("p", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("phrase"))
    rows = rows.join(spelled, "p").select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")
    order = (F.desc("score"), F.desc("a"), "phrase")
    # the first ones of each share of a language, then of the language
    part = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return part.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = """
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM t),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS p FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
f AS (SELECT lang, p, k, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, p, k, f AS a, string_split(p, ' ') AS s, unnest(range(1, k)) AS j FROM f WHERE k > 1),
x AS (SELECT c.lang, c.p, c.a, c.j, l.f AS l, r.f AS r, n.n,
             ((1000::HUGEINT * c.a * n.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
      FROM c JOIN n ON n.lang = c.lang JOIN f l ON l.lang = c.lang AND l.p = array_to_string(s[1:j], ' ')
      JOIN f r ON r.lang = c.lang AND r.p = array_to_string(s[j + 1:], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, j) AS o FROM x),
i AS (SELECT lang, f, string_split(p, ' ') AS s, k, unnest(range(2, k)) AS m FROM f WHERE k > 2),
y AS (SELECT lang, f, unnest([array_to_string(s[q:q + m - 1], ' ') for q in range(1, k - m + 2)]) AS p FROM i),
z AS (SELECT lang, p, max(f) AS most FROM y GROUP BY ALL),
o AS (SELECT b.lang, b.p AS phrase, a, l, r, n, score, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.p) AS rank
      FROM b LEFT JOIN z ON z.lang = b.lang AND z.p = b.p WHERE o = 1 AND (most IS NULL OR most < a))
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000
"""
