"""Spelling variants: groups of words that differ by one letter, found by a variable-length gram index.

1. Words are counted per task in bounded tables first, then by Spark.
2. Gram dictionary: a gram of QMIN letters is extended letter by letter, up to QMAX, as long as more than
   a limit of places hold it.  The limit grows with the number of places, so that at most MOST_FREQUENT
   grams of a length are extended: they and their counts are all that is broadcast.
3. A word, with margins of QMAX - 1 marks, is decomposed: from every place the shortest gram that is not
   frequent, but none that lies within an earlier one.  For each possible place of an edit, grams that
   end before it or beyond its reach are untouched; the least number of them over all places is the word's
   bound, so a near word shares so many grams with it, at the same distance from the begin or the end.
4. List merging: of a word's m grams with bound t only the m - t + 1 rarest lists need be looked at, as
   at least one of the shared grams is among them, on either side.  A list is kept by gram and distance.
   Lists of more than LONG words are divided by the words' one-letter deletions, which near words share.
5. Candidates of a list are compared by length, letter sets and common beginnings and ends.
6. Forms are followed to their ends by doubling steps.

Letters are U+0041 to U+005A, U+0061 to U+007A and U+00C0 to U+00FF, so a word is a row of bytes.
Nulls: a null text has no words; a null doc_id counts as empty text for the erasures.  Repeated rows count
like others.  Very long words are words; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import arrays
from panelcast.llm.lookup import distinct
from panelcast.llm.tables import share
from panelcast.sources.tables import materialise

LEAST_LENGTH, LEAST_COUNT, FACTOR, ERASED = 6, 5, 5, 199
QMIN, QMAX = 2, 6
#: Most grams of one length that are extended, and the least number of places for it.
MOST_FREQUENT, LEAST_LIMIT = 1 << 18, 32
#: Words of a list before it is divided by deletions; list entries for each bucket.
LONG, BUCKET_ENTRIES = 512, 200_000
#: Distinct words that a task counts before it sends them on.
FLUSH = 250_000
#: Letters of the words that are compared as rows of a matrix; longer ones are compared one by one.
WIDE = 40
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ np.where(t & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return t


_CRC = _crc_table()


def _crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of every stretch of bytes, going on from the crc32 in *state*."""
    size = ends - starts
    order = np.argsort(-np.minimum(size, 65), kind="stable")
    c, at, left = ~state[order], starts[order], size[order]
    long = int(np.searchsorted(-left, -64, "left"))  # these come first
    for k in range(64):
        n = int(np.searchsorted(-np.minimum(left, 65), -k, "left"))
        if n <= long:
            break
        i = slice(long, n)
        c[i] = _CRC[(c[i] ^ data[at[i] + k]) & np.uint32(255)] ^ (c[i] >> np.uint32(8))
    out = np.empty(len(c), np.uint32)
    out[order] = ~c
    for k in order[:long].tolist():
        out[k] = zlib.crc32(data[starts[k] : ends[k]].tobytes(), int(state[k]))
    return out


def runs_of_letters(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of letters and the row of each."""
    lead = data == 0xC3
    letter = _LETTER[data] | lead
    letter[1:] |= lead[:-1]
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    opens, closes = letter.copy(), letter.copy()
    opens[1:] &= ~letter[:-1] | cut[1:-1]
    closes[:-1] &= ~letter[1:] | cut[1:-1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(at, starts, "right") - 1


def counted_words(docs: DataFrame) -> DataFrame:
    """(word, n): the words of *docs* after the erasures."""

    def body(batches):
        seen: Counter = Counter()

        def sent():
            batch = pa.record_batch([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return batch

        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, at = arrays.utf8(batch.column(1))
            for a, b in arrays.runs(at):
                part = arrays.LOWER[data[at[a] : at[b]]]
                starts, ends, row = runs_of_letters(part, at[a : b + 1] - at[a])
                state = np.array([zlib.crc32(b"%s:" % (b"" if k is None else str(k).encode())) for k in ids[a:b]], np.uint32)
                crc = _crc32(part, starts, ends, state[row])
                marks = np.concatenate(([0], np.cumsum(part == 0xC3)))
                length = ends - starts - (marks[ends] - marks[starts])
                erased = crc % ERASED == 0
                for k in np.flatnonzero(erased & (length > LEAST_LENGTH)).tolist():
                    word = part[starts[k] : ends[k]].tobytes().decode()
                    place = int(crc[k]) % len(word)
                    seen[(word[:place] + word[place + 1 :]).encode()] += 1
                whole = np.flatnonzero(~erased & (length >= LEAST_LENGTH))
                starts, ends = starts[whole], ends[whole]
                _, first, n = np.unique(arrays.hashed(part, starts, ends), return_index=True, return_counts=True)
                body = part.tobytes()
                for s, e, k in zip(starts[first].tolist(), ends[first].tolist(), n.tolist(), strict=True):
                    seen[body[s:e]] += k
                if len(seen) >= FLUSH:
                    yield sent()
        if seen:
            yield sent()

    sent = docs.select("doc_id", "text").mapInArrow(body, "word string, n long")
    return sent.groupBy("word").agg(F.sum("n").alias("n"))


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte for each letter of a column of words, and where each word starts."""
    data, at = arrays.utf8(column)
    lead = data == 0xC3
    body = data.copy()
    body[1:][lead[:-1]] += 0x40
    before = np.concatenate(([0], np.cumsum(lead)))
    return body[~lead], at - before[at]


def _rows(body: np.ndarray, at: np.ndarray, which: np.ndarray, size: int, margin: int) -> np.ndarray:
    """The words *which*, all of *size* letters, as a matrix with margins of marks."""
    out = np.empty((len(which), size + 2 * margin), np.uint64)
    out[:, :margin], out[:, margin + size :] = 1, 2
    out[:, margin : margin + size] = body[at[:-1][which][:, None] + np.arange(size)]
    return out


def _by_length(body: np.ndarray, at: np.ndarray):
    """(size, indexes) of the words of each length, in pieces of about a million letters."""
    size = np.diff(at)
    for k in np.unique(size).tolist():
        which = np.flatnonzero(size == k)
        step = max(1, 1_000_000 // (k + 2 * QMAX))
        for a in range(0, len(which), step):
            yield k, which[a : a + step]


def _grams(x: np.ndarray, q: int) -> np.ndarray:
    """The grams of *q* letters from every place of each row, as numbers."""
    n = x.shape[1] - q + 1
    out = np.full((x.shape[0], n), np.uint64(q) << np.uint64(56))
    for k in range(q):
        out |= x[:, k : k + n] << np.uint64(8 * k)
    return out


def frequent_grams(words: DataFrame, limit: int) -> DataFrame:
    """(gram, n) of the grams that more than *limit* places hold."""

    def body(batches):
        held, n = [], 0

        def sent():
            value, count = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch([pa.array(value.view(np.int64)), pa.array(count)], ["gram", "n"])

        for batch in batches:
            text, at = letters(batch.column(0))
            for size, which in _by_length(text, at):
                x = _rows(text, at, which, size, QMAX - 1)
                for q in range(QMIN, QMAX + 1):
                    g = _grams(x, q)[:, : size + QMAX - 1].reshape(-1)
                    held.append(g)
                    n += len(g)
                if n > 4_000_000:
                    yield sent()
                    held, n = [], 0
        if held:
            yield sent()

    sent = words.select("word").mapInArrow(body, "gram long, n long")
    return sent.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > limit)


def decomposed(x: np.ndarray, size: int, known: np.ndarray, count: np.ndarray):
    """Of words of *size* letters: grams by place, their counts (large where none is kept) and the bounds."""
    places = size + QMAX - 1
    gram = _grams(x, QMIN)[:, :places]
    end = np.broadcast_to(np.arange(places) + QMIN - 1, gram.shape).copy()
    n = np.zeros(gram.shape, np.int64)
    growing = np.ones(gram.shape, bool)
    for q in range(QMIN, QMAX + 1):
        at = np.minimum(np.searchsorted(known, gram), max(len(known) - 1, 0))
        often = growing & (known[at] == gram) if len(known) else np.zeros(gram.shape, bool)
        n = np.where(growing, np.where(often, count[at] if len(known) else 0, 0), n)
        growing = often
        if q < QMAX:
            gram = np.where(growing, _grams(x, q + 1)[:, :places], gram)
            end += growing
    top = np.maximum.accumulate(end, axis=1)
    kept = np.ones(gram.shape, bool)
    kept[:, 1:] = end[:, 1:] > top[:, :-1]
    bound = np.full(len(x), places)
    for i in range(QMAX - 1, QMAX - 1 + size):  # the letter that an edit touches
        bound = np.minimum(bound, (kept & ((end < i) | (end > i + QMAX - 1))).sum(1))
    return gram, np.where(kept, n, np.iinfo(np.int64).max), kept.sum(1), bound


def list_entries(words: DataFrame, known) -> DataFrame:
    """(key, turned, word): the lists, by gram and distance from the begin or the end, that a word enters."""

    def body(batches):
        grams, counts = known.value
        for batch in batches:
            text, at = letters(batch.column(0))
            for size, which in _by_length(text, at):
                gram, n, m, bound = decomposed(_rows(text, at, which, size, QMAX - 1), size, grams, counts)
                order = np.lexsort((gram, n), axis=1)
                row, rank = np.nonzero(np.arange(gram.shape[1]) < (m - np.maximum(bound, 1) + 1)[:, None])
                place = order[row, rank]
                g = gram[row, place]
                word = batch.column(0).take(pa.array(which[row]))
                for turned, distance in ((False, place), (True, size + QMAX - 1 - place)):
                    key = arrays.mix(g ^ arrays.mix(distance.astype(np.uint64) * np.uint64(2) + np.uint64(turned)))
                    yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(np.full(len(row), turned)), word], ["key", "turned", "word"])

    return words.select("word").mapInArrow(body, "key long, turned boolean, word string")


def near(a: str, b: str) -> bool:
    """Whether exactly one letter is inserted, deleted or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def merged(table):
    """The near words (a, b) that meet in the lists of one bucket."""
    table = table.sort_by("key")
    key, turned = table["key"].to_numpy(), table["turned"].to_numpy()
    word = table["word"].combine_chunks()
    body, at = letters(word)
    size = np.diff(at)
    short = size <= WIDE
    left, right = np.zeros((len(size), WIDE), np.uint8), np.zeros((len(size), WIDE), np.uint8)
    marks = np.zeros(len(size), np.uint64)
    for k in range(min(WIDE, int(size.max(initial=0)))):
        has = np.flatnonzero(size > k)
        letter = body[at[:-1][has] + k]
        left[has, k] = letter
        right[has, k] = body[at[1:][has] - 1 - k]
        marks[has] |= np.uint64(1) << (letter & np.uint8(63)).astype(np.uint64)
    out = [], []
    i, step = np.arange(len(key)), 1
    while len(i):
        i = i[i + step < len(key)]
        i = i[key[i] == key[i + step]]
        j = i + step
        gap = np.abs(size[i] - size[j])
        # in lists by the distance from the end words of one length have met in those from the begin
        good = (gap == 1) | ((gap == 0) & ~turned[i])
        good &= (np.bitwise_count(marks[i] ^ marks[j]) <= 2) | ~(short[i] & short[j])
        u, v = i[good], j[good]
        both = short[u] & short[v]
        a, b = u[both], v[both]
        for lo in range(0, len(a), 200_000):
            x, y = a[lo : lo + 200_000], b[lo : lo + 200_000]
            differ, back = left[x] != left[y], right[x] != right[y]
            ahead = np.where(differ.any(1), differ.argmax(1), WIDE)
            behind = np.where(back.any(1), back.argmax(1), WIDE)
            yes = differ.any(1) & (ahead + behind >= np.maximum(size[x], size[y]) - 1)
            out[0].append(x[yes])
            out[1].append(y[yes])
        yes = [near(word[p].as_py(), word[q].as_py()) for p, q in zip(u[~both].tolist(), v[~both].tolist(), strict=True)]
        out[0].append(u[~both][np.array(yes, bool)])
        out[1].append(v[~both][np.array(yes, bool)])
        step += 1
    x, y = (np.concatenate([np.zeros(0, np.int64), *p]) for p in out)
    return pa.table({"a": word.take(pa.array(x)), "b": word.take(pa.array(y))})


def near_words(words: DataFrame) -> DataFrame:
    """(word, other): all pairs of near words, both ways."""
    places = words.agg(F.sum(F.length("word") + F.lit(QMAX - 1))).first()[0] or 0
    rows = frequent_grams(words, max(LEAST_LIMIT, places // MOST_FREQUENT)).collect()  # MOST_FREQUENT of each length at most
    table = np.array(sorted(map(tuple, rows)), np.int64).reshape(-1, 2)
    known = share(words.sparkSession, (table[:, 0].astype(np.uint64), table[:, 1]))
    entries = materialise(list_entries(words, known))
    sizes = entries.groupBy("key").agg(F.count("*").alias("n"))
    met = materialise(sizes.where("n > 1"))
    total = met.agg(F.sum("n")).first()[0] or 0
    long = met.where(F.col("n") > LONG).select("key")
    # a list of one word holds no pair
    plain = entries.join(met.where(F.col("n") <= LONG).select("key"), "key", "left_semi")
    cut = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.length("word"))))
    parts = F.array_distinct(F.array_union(F.array("word"), cut))
    divided = entries.join(long, "key", "left_semi").select(F.explode(parts).alias("part"), "key", "turned", "word")
    divided = divided.select(F.xxhash64("key", "part").alias("key"), "turned", "word")
    n = max(32, total // BUCKET_ENTRIES)
    both = plain.union(divided).groupBy(F.pmod("key", F.lit(n)).alias("bucket"))
    pairs = both.applyInArrow(merged, "a string, b string").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = materialise(pairs.distinct())
    return pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).union(pairs.select("b", "a"))


def ends(links: DataFrame) -> DataFrame:
    """(word, root): where the links (word, form) end, by steps that double."""
    state = materialise(links.select("word", F.col("form").alias("root")))
    while True:
        on = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        state = materialise(state.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if state.where("moved").isEmpty():
            return state.select("word", "root")
        state = state.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of *docs*."""
    words = materialise(counted_words(docs).where(F.col("n") >= LEAST_COUNT))
    other = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    found = near_words(words).join(other, "other").groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    fits = -F.col("best.less") >= FACTOR * F.col("n")
    rows = words.join(found, "word", "left").select(
        "word",
        F.when(fits, F.col("best.form")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(fits, -F.col("best.less")).alias("form_n"),
    )
    rows = materialise(rows)
    roots = ends(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: Words by their crc32, near words by equal deletions at one place, and forms followed by recursion.
SQL = """
WITH RECURSIVE t AS (SELECT list(x ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS x
  FROM (SELECT unnest(range(256)) AS i))),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[A-Za-z\\x{C0}-\\x{FF}]+')) AS w FROM documents),
d AS (SELECT doc_id, w, count(*) AS c FROM r WHERE length(w) >= 6 GROUP BY ALL),
b AS (SELECT w, c, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''),
             lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, unicode(x)::BIGINT - 64] END)) AS y FROM d),
h AS (SELECT w, c, xor(list_reduce(list_prepend(4294967295, y), lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1])), 4294967295) AS h FROM b, t),
e AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, (h % length(w))::BIGINT) || substr(w, (h % length(w) + 2)::BIGINT) ELSE w END AS word, c FROM h),
n AS (SELECT word, sum(c)::BIGINT AS n FROM e WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
v AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS part FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM n)),
p AS (SELECT a.word, b.word AS other FROM v a JOIN v b ON a.part = b.part AND a.i = b.i AND a.word <> b.word
      UNION SELECT v.word, n.word FROM v JOIN n ON v.part = n.word UNION SELECT n.word, v.word FROM v JOIN n ON v.part = n.word),
f AS (SELECT p.word, count(*) AS n_near, arg_min({'other': other, 'n': n.n}, {'m': -n.n, 'o': encode(other)}) AS best
      FROM p JOIN n ON n.word = p.other GROUP BY p.word),
g AS (SELECT n.word, n.n, coalesce(n_near, 0)::BIGINT AS n_near,
             CASE WHEN best.n >= 5 * n.n THEN best.other END AS form, CASE WHEN best.n >= 5 * n.n THEN best.n END AS form_n
      FROM n LEFT JOIN f USING (word)),
s AS (SELECT word, word AS root, 0 AS k FROM n UNION ALL SELECT s.word, g.form, k + 1 FROM s JOIN g ON g.word = s.root WHERE g.form IS NOT NULL)
SELECT g.word, g.form, arg_max(s.root, s.k) AS root, g.n, g.n_near, g.form_n::BIGINT AS form_n FROM g JOIN s USING (word)
GROUP BY g.word, g.form, g.n, g.n_near, g.form_n
"""
