"""Exact removal of repeated word runs: fixed-block anchors.

A window is *width* consecutive words of one text.  Every window that occurs elsewhere as well,
in the same text or another, has its words removed; windows are judged on the input.

1. Reference blocks: each text is cut into blocks of (width + 1) / 2 words from its start.  Any
   window holds exactly one whole block, so a window can only be repeated if its block also stands
   somewhere else, at any position.  Every rolling block-wide window probes the blocks: hashes go,
   counted per task first, into buckets, where a block met twice is a hit.
2. Extension: only windows that hold a hit block are compared whole.  Consecutive repeated windows
   run together into maximal exact repeats, whose words are removed.
3. Only texts that keep a part of their words travel to meet their repeats.

Hashes have 64 bits; equality of windows is equality of hashes.  A window that repeats within a
task is known there and sent once, so a passage that a third of all texts share puts at most one
row per task into its bucket.  Nulls: a null text has no words; rows are told apart by doc_id and
text together, so repeated rows and null ids are rows like others (a repeated row repeats its
windows).  A text shorter than *width* words is kept whole.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from panelcast.llm import arrays
from panelcast.llm.tables import bit_set, bucket_bits, share
from panelcast.sources.tables import materialise

WIDTH = 35
#: Hashes that a task gathers before it sends them off.
FLUSH = 2_000_000
_PACKED = "bucket int, keys binary, again binary, docs binary, sizes binary, counts binary, places binary"


def _row_key(doc_id, text: bytes) -> int:
    return xxhash.xxh64_intdigest(text, 0 if doc_id is None else doc_id & 0x7FFFFFFF) ^ (
        0 if doc_id is None else xxhash.xxh64_intdigest(str(doc_id).encode())
    )


def _row_keys(ids: pa.Array, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    body = memoryview(data)
    return np.array(
        [_row_key(k, body[a:b]) for k, a, b in zip(ids.to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True)],
        np.uint64,
    )


def _slices(batches, doc_at: int | None = None):
    """(word hashes, first words, row keys) of each run of rows."""
    for batch in batches:
        data, at = arrays.utf8(batch.column(batch.num_columns - 1))
        keys = _row_keys(batch.column(doc_at), data, at) if doc_at is not None else None
        for a, b in arrays.runs(at):
            h, first = arrays.words(data[at[a] : at[b]], at[a : b + 1] - at[a])
            yield h, first, keys[a:b] if keys is not None else None


def _block_starts(first: np.ndarray, block: int) -> np.ndarray:
    counts = np.diff(first) // block
    row = np.repeat(np.arange(len(counts)), counts)
    return first[:-1][row] + block * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))


def block_hits(docs: DataFrame, bits: int, block: int) -> DataFrame:
    """x: the leading bits + 32 bits of the hash of every block that stands at two places."""

    def packed(grams, blocks):
        value, n = np.unique(np.concatenate(grams), return_counts=True)
        value = np.sort(np.concatenate((value, value[n > 1])))  # twice is enough to know
        block = np.unique(np.concatenate(blocks))
        edges = np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32)
        low = np.uint64(0xFFFFFFFF)
        columns = [
            pa.array(np.arange(1 << bits, dtype=np.int32)),
            *(arrays.blobs((x & low).astype(np.uint32), np.searchsorted(x, edges)) for x in (value, block)),
        ]
        return pa.record_batch(columns, ["bucket", "grams", "blocks"])

    def send(batches):
        grams, blocks, held = [], [], 0
        for h, first, _ in _slices(batches):
            key = arrays.windows(h, block) >> np.uint64(32 - bits)
            at, _ = arrays.starts_of(first, block)
            if len(at):
                grams.append(key[at])
                blocks.append(key[_block_starts(first, block)])
                held += len(at)
            if held >= FLUSH:
                yield packed(grams, blocks)
                grams, blocks, held = [], [], 0
        if held:
            yield packed(grams, blocks)

    def meet(table):
        gram, block = (
            np.sort(np.frombuffer(b"".join(x for x in table[c].to_pylist()), np.uint32)) for c in ("grams", "blocks")
        )
        hit = np.intersect1d(gram[1:][gram[1:] == gram[:-1]], block)
        bucket = table["bucket"][0].as_py() if table.num_rows else 0
        return pa.table({"x": pa.array(hit.astype(np.int64) + (bucket << 32))})

    sent = docs.select("text").mapInArrow(send, "bucket int, grams binary, blocks binary")
    return sent.groupBy("bucket").applyInArrow(meet, "x long")


def _by_bucket(bucket, n, keys, again, again_bucket, docs, doc, sizes, place):
    """Rows for each bucket; entries are in order of documents and stay so."""
    order = np.argsort(bucket, kind="stable")
    bucket, doc, place = bucket[order], doc[order], place[order]
    edges = np.arange(n + 1)
    cuts = np.searchsorted(bucket, edges)
    change = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (doc[1:] != doc[:-1])))) if len(doc) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate((change, [len(doc)]))).astype(np.uint32)
    doc_cuts = np.searchsorted(bucket[change], edges)
    key_column = arrays.blobs(keys[order], cuts) if keys is not None else pa.nulls(n, pa.binary())
    again = again[np.argsort(again_bucket, kind="stable")]
    columns = [
        pa.array(np.arange(n, dtype=np.int32)),
        key_column,
        arrays.blobs(again, np.searchsorted(np.sort(again_bucket), edges)),
        arrays.blobs(docs[doc[change]], doc_cuts),
        arrays.blobs(sizes[doc[change]], doc_cuts),
        arrays.blobs(counts, doc_cuts),
        arrays.blobs(place, cuts),
    ]
    batch = pa.record_batch(columns, ["bucket", "keys", "again", "docs", "sizes", "counts", "places"])
    used = (np.diff(cuts) > 0) | (np.diff(np.searchsorted(np.sort(again_bucket), edges)) > 0)
    return batch.filter(pa.array(used))


def _joined(table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x or b"" for x in table[name].to_pylist()), kind)


def repeats(docs: DataFrame, hits, bits: int, buckets: int, width: int, block: int) -> DataFrame:
    """(row_key, n_words, removed, covered): the words of each text that lie in repeated windows.

    covered holds pairs of 32-bit numbers, first word and word after the last of each repeat.
    """
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    shift = np.uint64(63) if buckets < 2 else shift

    def packed(held):
        key, doc, place = (np.concatenate(x) for x in zip(*held["entries"], strict=True))
        docs_, sizes = np.concatenate(held["docs"]), np.concatenate(held["sizes"])
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        again = np.unique(key[twice])
        one = ~twice
        none = np.zeros(0, np.uint64)
        yield _by_bucket((key[one] >> shift).astype(np.int64), buckets, key[one], again, (again >> shift).astype(np.int64), docs_, doc[one], sizes, place[one])
        if twice.any():  # known here, passed on with null keys
            yield _by_bucket((docs_[doc[twice]] >> shift).astype(np.int64), buckets, None, none, none.astype(np.int64), docs_, doc[twice], sizes, place[twice])

    def send(batches):
        held, n, rows = {"entries": [], "docs": [], "sizes": []}, 0, 0
        for h, first, keys in _slices(batches, 0):
            start, row = arrays.starts_of(first, width)
            if len(start):
                blocks = _block_starts(first, block)
                hit = np.zeros(len(h) + 1, bool)
                hit[blocks] = hits.value.has(arrays.windows(h, block)[blocks] >> np.uint64(32 - bits))
                local = start - first[:-1][row]
                alive = hit[first[:-1][row] - (-local // block) * block]
                start, row, local = start[alive], row[alive], local[alive]
                if len(start):
                    held["entries"].append((arrays.windows(h, width)[start], (row + rows).astype(np.int64), local.astype(np.uint32)))
                    held["docs"].append(keys)
                    held["sizes"].append(np.diff(first).astype(np.uint32))
                    rows += len(keys)
                    n += len(start)
            if n >= FLUSH:
                yield from packed(held)
                held, n, rows = {"entries": [], "docs": [], "sizes": []}, 0, 0
        if n:
            yield from packed(held)

    def meet(table):
        key, again = _joined(table, "keys", np.uint64), np.unique(_joined(table, "again", np.uint64))
        own = np.array([x is not None for x in table["keys"].to_pylist()], bool)
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        if len(again) and len(key):
            twice |= again[np.minimum(np.searchsorted(again, key), len(again) - 1)] == key
        out = []
        for mine, verdict in ((own, twice), (~own, None)):
            part = table.filter(pa.array(mine))
            docs_, sizes, counts = _joined(part, "docs", np.uint64), _joined(part, "sizes", np.uint32), _joined(part, "counts", np.uint32)
            doc, place = np.repeat(np.arange(len(docs_)), counts), _joined(part, "places", np.uint32)
            if verdict is not None:
                doc, place = doc[verdict], place[verdict]
            if len(doc):
                none = np.zeros(0, np.uint64)
                out.append(_by_bucket((docs_[doc] >> shift).astype(np.int64), buckets, None, none, none.astype(np.int64), docs_, doc, sizes, place))
        return pa.Table.from_batches(out) if out else table.schema.empty_table()

    def covered(table):
        docs_, sizes, counts = _joined(table, "docs", np.uint64), _joined(table, "sizes", np.uint32), _joined(table, "counts", np.uint32)
        doc, place = np.repeat(docs_, counts), _joined(table, "places", np.uint32).astype(np.int64)
        size = np.repeat(sizes, counts).astype(np.int64)
        order = np.lexsort((place, doc))
        doc, place, size = doc[order], place[order], size[order]
        if not len(doc):
            return pa.table({x: pa.array([], pa.int64()) for x in ("row_key", "n_words", "removed")} | {"covered": pa.array([], pa.binary())})
        opens = np.concatenate(([True], (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + width)))
        at = np.flatnonzero(opens)
        ends = place[np.concatenate((at[1:], [len(place)])) - 1] + width
        pairs = np.stack((place[at], ends), axis=1).astype(np.uint32)
        change = np.flatnonzero(np.concatenate(([True], doc[at][1:] != doc[at][:-1])))
        cuts = np.concatenate((change, [len(at)]))
        columns = (doc[at][change].view(np.int64), size[at][change], np.add.reduceat(ends - place[at], change))
        return pa.table(dict(zip(("row_key", "n_words", "removed"), map(pa.array, columns), strict=True)) | {"covered": arrays.blobs(pairs, cuts)})

    sent = docs.select("doc_id", "text").mapInArrow(send, _PACKED)
    met = sent.groupBy("bucket").applyInArrow(meet, _PACKED)
    return met.groupBy("bucket").applyInArrow(covered, "row_key long, n_words long, removed long, covered binary")


def kept_words(text: bytes, covered: bytes) -> list[bytes]:
    out, at, words = [], 0, text.split()
    for a, b in np.frombuffer(covered, np.uint32).reshape(-1, 2).tolist():
        out += words[at:a]
        at = b
    return out + words[at:]


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of every row; kept is null where nothing was removed."""
    spark, block = docs.sparkSession, (width + 1) // 2
    docs = docs.select("doc_id", "text")
    bits = bucket_bits(docs)
    hits = materialise(block_hits(docs, bits, block))
    n = hits.count()
    hit_bits = share(spark, bit_set(hits, n))
    found = materialise(repeats(docs, hit_bits, bits, 1 << max(5, bits - 3), width, block))
    partial = found.where("removed < n_words")
    partial_bits = share(spark, bit_set(partial.select("row_key"), partial.count()))

    def scan(batches):
        for batch in batches:
            data, at = arrays.utf8(batch.column(1))
            keys = _row_keys(batch.column(0), data, at)
            part, body = partial_bits.value.has(keys), memoryview(data)
            n_words, sha, text = [], [], []
            for p, a, b in zip(part.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                raw = bytes(body[a:b])
                words = raw.split()
                n_words.append(len(words))
                sha.append(None if p else hashlib.sha256(b" ".join(words)).hexdigest())
                text.append(raw if p else None)
            yield pa.record_batch(
                [batch.column(0), pa.array(keys.view(np.int64)), pa.array(n_words, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.binary())],
                ["doc_id", "row_key", "n_words", "sha", "raw"],
            )

    nothing = hashlib.sha256(b"").hexdigest()

    def finish(batches):
        for batch in batches:
            doc_id, n_words, sha, raw, covered = (batch.column(i) for i in range(5))
            removed, shas, kept = [], [], []
            for n, s, t, c in zip(n_words.to_pylist(), sha.to_pylist(), raw.to_pylist(), covered.to_pylist(), strict=True):
                gone = int(np.diff(np.frombuffer(c, np.uint32).astype(np.int64).reshape(-1, 2)).sum()) if c else 0
                if t is not None and c:
                    left = b" ".join(kept_words(t, c))
                    s, out = hashlib.sha256(left).hexdigest(), left.decode()
                elif gone:
                    s, out = nothing, ""
                else:
                    s, out = s or hashlib.sha256(b" ".join(t.split())).hexdigest(), None
                removed.append(gone)
                shas.append(s)
                kept.append(out)
            yield pa.record_batch(
                [doc_id, n_words, pa.array(removed, pa.int64()), pa.array(shas), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    rows = docs.mapInArrow(scan, "doc_id long, row_key long, n_words long, sha string, raw binary")
    met = rows.join(found.select("row_key", "covered"), "row_key", "left")
    return met.select("doc_id", "n_words", "sha", "raw", "covered").mapInArrow(
        finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    )

