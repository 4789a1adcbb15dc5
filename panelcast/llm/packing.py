"""Packing into sequences of fixed length by cutting-stock column generation.

1. Each text is tokenised once; its ids and a closing 0 are cut at multiples of LENGTH.  Whole pieces
   are sequences by themselves, so only the last pieces, shorter than LENGTH, are to be packed.
2. Their length histogram, LENGTH - 1 numbers whatever the input, is all the driver sees.  Lengths are
   taken together in classes of CLASS.  A linear program chooses how often each pattern of classes is
   used; a knapsack program over the classes prices new patterns with the duals until none is worth
   more than a small tolerance.
3. The uses are rounded down; what is left, a number of pieces that depends on the number of classes
   only, is put together by subset sums over the true lengths, longest piece first.
4. Pieces are ranked within their length, in parts of bounded size; each rank finds its pattern and
   sequence by binary search, and offsets are running sums within a sequence.
Nulls and empty texts are the closing 0 alone.  Repeated rows and null ids are rows like others;
pieces of equal rows are interchangeable.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm import arrays
from panelcast.llm.tables import share
from panelcast.sources.tables import materialise

LENGTH, CLASS, TOLERANCE, MOST_ROUNDS, PART_ROWS = 1024, 8, 0.001, 5000, 50_000
#: Pretokens that a task remembers, and their ids; beyond either it starts afresh.  Both stores are made once.
MOST_KNOWN, MOST_IDS = 200_000, 1_200_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_letter() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the
    others in order from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_CLASS = np.full(256, 3, np.uint8)  # 0 space, 1 letter, 2 digit, 3 other
_CLASS[[9, 10, 13, 32]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_ODD = np.ones(256, bool)  # bytes for which these classes and the pattern may differ
_ODD[[9, 10, 13, *range(32, 39), *range(40, 127), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = False


class Encoder:
    """Ids of texts by the tokenizer file; every distinct pretoken is encoded once.

    Merges never cross pretokens, so the ids of a text are those of its pretokens in a row.  Plain
    Latin text is cut into pretokens by vectorised class changes; a pretoken is known by its 64-bit
    hash.  Texts with an apostrophe or other characters are encoded whole, texts with the name of a
    special token by the tokenizer itself.
    """

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = [t.encode() for t in added]
        letters = _byte_of_letter()
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        # in this vocabulary ids are in the order of the merges, so an id is its token's rank
        ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if t not in added}
        self.whole = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.forget()

    def forget(self) -> None:
        """Pretokens by their hashes in order, their numbers, and the ids of each number."""
        self.known, self.code = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids, self.at = np.empty(MOST_IDS, np.uint32), np.zeros(MOST_KNOWN + 1, np.int64)
        self.n = 0

    def _learn(self, keys: np.ndarray, found: list[list[int]]) -> None:
        """Adds pretokens that are not known; afterwards all known hashes are in order again."""
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        a, b, n = int(self.at[self.n]), int(self.at[self.n] + sizes.sum()), self.n + len(found)
        if n >= len(self.at) or b > len(self.ids):  # one run with more than all the room: a store of its own
            self.at = np.concatenate((self.at[: self.n + 1], np.zeros(len(found), np.int64)))
            self.ids = np.concatenate((self.ids[:a], np.empty(b - a, np.uint32)))
        self.ids[a:b] = np.fromiter((i for x in found for i in x), np.uint32, b - a)
        self.at[self.n + 1 : n + 1] = a + np.cumsum(sizes)
        order = np.argsort(known := np.concatenate((self.known, keys)), kind="stable")
        self.code = np.concatenate((self.code, np.arange(self.n, n, dtype=np.int32)))[order]
        self.known, self.n = known[order], n

    def _plain(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of rows of plain text and where each row begins."""
        kind = _CLASS[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[at] = True
        same = ~cut[1:-1]  # the next byte is of the same row
        change = kind[1:] != kind[:-1]
        start = cut[:-1].copy()
        start[1:] |= change & ~((data[:-1] == 32) & same)  # a blank belongs to what follows
        start[:-1] |= (kind[:-1] == 0) & (kind[1:] != 0) & same  # and so ends the white space before it
        s = np.flatnonzero(start)
        e = np.append(s[1:], len(data))
        key = arrays.hashed(data, s, e)
        uniq, first, back = np.unique(key, return_index=True, return_inverse=True)
        new = self._unknown(uniq)
        if self.n + new.sum() > MOST_KNOWN or self.at[self.n] > MOST_IDS // 2:
            self.forget()
            new = self._unknown(uniq)
        if new.any():
            raw, i = data.tobytes(), first[new]
            self._learn(uniq[new], [self.whole.encode_ordinary(raw[a:b].decode()) for a, b in zip(s[i].tolist(), e[i].tolist(), strict=True)])
        code = self.code[np.searchsorted(self.known, uniq)][back.reshape(-1)]
        size = self.at[code + 1] - self.at[code]
        ends = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.repeat(self.at[code] - ends[:-1], size) + np.arange(ends[-1])]
        return ids, ends[np.searchsorted(s, at)]

    def _unknown(self, keys: np.ndarray) -> np.ndarray:
        place = np.searchsorted(self.known, keys)
        new = place == len(self.known)
        new[~new] = self.known[place[~new]] != keys[~new]
        return new

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, a 0 after each text, and where each text begins."""
        bad = np.concatenate(([0], np.cumsum(_ODD[data])))
        two = np.zeros(len(data), bool)
        two[1:] = (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # signs among the letters
        bad += np.concatenate(([0], np.cumsum(two)))
        plain = bad[at[1:]] == bad[at[:-1]]
        body = memoryview(data)
        if any(t in body.tobytes() for t in self.special):
            plain &= ~np.array([any(t in bytes(body[a:b]) for t in self.special) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
        sizes = np.where(plain, np.diff(at), 0)
        own_at = np.concatenate(([0], np.cumsum(sizes)))
        mine = data if plain.all() else data[np.repeat(plain, np.diff(at))]
        ids, first = self._plain(mine, own_at) if len(mine) else (np.zeros(0, np.uint32), np.zeros(len(at), np.int64))
        if not plain.all():
            parts = [ids[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            for k in np.flatnonzero(~plain).tolist():
                text = bytes(body[at[k] : at[k + 1]])
                if any(t in text for t in self.special):
                    parts[k] = np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32)
                else:
                    parts[k] = np.array(self.whole.encode_ordinary(text.decode()), np.uint32)
            ids, first = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        return np.insert(ids, first[1:], 0), first + np.arange(len(first))


def pieces(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of every piece."""

    def body(batches):
        encoder = Encoder(path)  # goes with the task
        for batch in batches:
            data, at = arrays.utf8(batch.column(1))
            for lo, hi in arrays.runs(at):
                part = batch.slice(lo, hi - lo)
                ids, first = encoder.encode(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                ids = ids.astype("<u4")
                rows = []
                for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    for s in range(a, b, length):
                        e = min(s + length, b)
                        rows.append((i, s - a, e - s, zlib.crc32(ids[s:e]), b - a))
                columns = np.array(rows, np.int64).reshape(-1, 5).T
                yield pa.record_batch(
                    [part.column(0).take(pa.array(columns[0])), *map(pa.array, columns[1:])],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )
        del encoder
        pa.default_memory_pool().release_unused()  # the worker lives on

    return docs.select("doc_id", "text").mapInArrow(body, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def padded(total, length: int = LENGTH):
    """The length of a sequence with *total* ids: a power of two stays, others are padded."""
    total = np.asarray(total)
    return np.where((total & (total - 1)) == 0, total, length)


def _best_pattern(units: np.ndarray, value: np.ndarray, room: int) -> np.ndarray:
    """The pattern of the highest value within *room*, by dynamic programming."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        best[c], pick[c] = best[c - 1], -1
        k = int(np.searchsorted(units, c, "right"))
        if k:
            worth = best[c - units[:k]] + value[:k]
            i = int(worth.argmax())
            if worth[i] > best[c] + 1e-12:
                best[c], pick[c] = worth[i], i
    column, c = np.zeros(len(units)), room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            column[pick[c]] += 1
            c -= units[pick[c]]
    return column


def solve(units: np.ndarray, need: np.ndarray, room: int):
    """Patterns (rows of counts by class) and how often the linear program uses each."""
    times = room // units
    columns = np.diag(times.astype(float))
    inverse, x = np.diag(1.0 / times), need / times
    for _ in range(MOST_ROUNDS):
        dual = inverse.sum(0)
        column = _best_pattern(units, dual, room)
        if dual @ column <= 1 + TOLERANCE:  # the duals over this are feasible: so near is the optimum
            break
        d = inverse @ column
        able = d > 1e-9
        if not able.any():
            break
        step = np.where(able, x / np.where(able, d, 1.0), np.inf)
        r = int(step.argmin())
        size = step[r]
        x = np.maximum(x - size * d, 0.0)
        x[r] = size
        inverse[r] /= d[r]
        d[r] = 0.0
        inverse -= np.outer(d, inverse[r])
        columns[:, r] = column
    return columns.T.astype(np.int64), x


def _fill(left: dict[int, int], room: int, most: int = 64) -> list[int]:
    """Pieces with the largest sum within *room*, by subset sums over the longest *most* lengths that fit."""
    kinds = sorted((k for k, n in left.items() if n and k <= room), reverse=True)
    kinds = kinds[:most // 2] + kinds[most // 2 :][-(most // 2) :]
    masks, all_ = [1], (1 << (room + 1)) - 1
    for k in kinds:
        mask = masks[-1]
        for _ in range(min(left[k], room // k)):
            mask |= (mask << k) & all_
        masks.append(mask)
    total, out = masks[-1].bit_length() - 1, []
    for i in range(len(kinds), 0, -1):
        while not masks[i - 1] >> total & 1:
            out.append(kinds[i - 1])
            total -= kinds[i - 1]
    return out


def plan(histogram: dict[int, int], length: int = LENGTH, unit: int = CLASS) -> dict[str, np.ndarray]:
    """Where the ranks of each class go: sorted keys (class * 2**40 + first rank), copies in a sequence
    and first sequence; and for each length the rank of its first piece within the class."""
    whole = histogram.get(length, 0)
    short = {k: n for k, n in histogram.items() if k < length}
    class_of = lambda k: -(-k // unit)
    base, size = np.zeros(length + 1, np.int64), {}
    for k in sorted(short, reverse=True):
        base[k] = size.get(class_of(k), 0)
        size[class_of(k)] = base[k] + short[k]
    used, done, rows, sequence = [], dict.fromkeys(size, 0), [], whole
    if whole:
        rows.append((class_of(length + unit) << 40, 1, 0))
    if size:
        units = np.array(sorted(size))
        patterns, x = solve(units, np.array([size[u] for u in units.tolist()], float), length // unit)
        for pattern, times in zip(patterns, np.floor(x + 1e-9).astype(np.int64).tolist(), strict=True):
            parts = {u: c for u, c in zip(units.tolist(), pattern.tolist(), strict=True) if c}
            times = min([times, *((size[u] - done[u]) // c for u, c in parts.items())])
            if times > 0:
                used.append((parts, times))
                for u, c in parts.items():
                    rows.append(((u << 40) + done[u], c, sequence))
                    done[u] += c * times
                sequence += times
    # the pieces left over, each with its rank within its class
    left: dict[int, list[int]] = {}
    for k, n in short.items():
        ranks = range(max(int(base[k]), done[class_of(k)]), int(base[k]) + n)
        if len(ranks):
            left[k] = list(ranks)
    while left:
        top = max(left)
        first = left[top].pop()
        chosen = [(top, first)]
        counts = {k: len(v) for k, v in left.items()}
        for k in _fill(counts, length - top):
            chosen.append((k, left[k].pop()))
        rows += [((class_of(k) << 40) + r, 1, sequence) for k, r in chosen]
        left = {k: v for k, v in left.items() if v}
        sequence += 1
    base[length] = 0
    table = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return dict(zip(("key", "copies", "sequence"), table.T, strict=True)) | {"base": base}


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, unit: int = CLASS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece of *docs*."""
    cut = materialise(pieces(docs, tokenizer or default_tokenizer(), length))
    histogram = {int(k): int(n) for k, n in cut.groupBy("length").count().collect()}  # LENGTH rows at most
    table = share(docs.sparkSession, plan(histogram, length, unit))
    bits = max(0, int(np.ceil(np.log2(max(histogram.values(), default=1) / PART_ROWS))))
    key = F.xxhash64("doc_id", "start", "ids_crc32")
    rows = cut.withColumn("key", key).withColumn("part", F.pmod("key", F.lit(1 << bits)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("length", "part").count().select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "part").orderBy("key", "doc_id", "start")
    ranked = rows.withColumn("place", F.row_number().over(within)).join(sums, ["length", "part"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("place") - 1).alias("rank"))

    def body(batches):
        t = table.value
        for batch in batches:
            size, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 5))
            group = np.where(size == length, -(-(length + unit) // unit), -(-size // unit))
            rank = rank + t["base"][size]
            i = np.searchsorted(t["key"], (group << 40) + rank, "right") - 1
            k = rank - (t["key"][i] & ((1 << 40) - 1))
            columns = [*(batch.column(j) for j in range(5)), pa.array(t["sequence"][i] + k // t["copies"][i]), pa.array(rank)]
            yield pa.record_batch(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "rank"])

    placed = ranked.mapInArrow(
        body, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, rank long"
    )
    ahead = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0))).drop("rank")
