"""MinHash fingerprints, near-duplicate classes by signature bands, and the edited-text test.

A signature holds, for each of PERMUTATIONS universal hash functions, the least value over a text's
five-word shingles, kept as 16 bits; the likeness of two signatures is the part of equal positions,
an estimate of the Jaccard similarity of the shingle sets.  Equal texts have equal fingerprints.

Near duplicates: signatures are cut into bands; sets that agree in a band and share 80 percent of
their union are linked, and the classes are the components of all links.  Each set is first compared
with the least of its band, which is linear in a band's size and settles most bands.  In a band whose
sets are of several classes after that, and after a few more leaders, the rest is settled within the band:
sizes and parities (exact bounds of the common part) tell which pairs across classes may link, only the
sets of such pairs travel, and a pair is compared where its sets are of different classes still.  What
leaves a band is a row for each set that may link, then a row for each link that joins two classes.

The edited text of a row ends with the beginning of the next row's text in descending order of
doc_id (equal ids: by text).  Rows are range-partitioned by doc_id into parts of bounded bytes and
travel as compressed Arrow blocks; each part also gets the first row of the part below.

Nulls and empty texts have n_chars 0 and a constant fingerprint.  A null doc_id comes last in the
order.  Repeated rows are rows like others.  A single row is its own next.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import arrays
from panelcast.llm.shingles import WIDTH, common, linked, needed_sets, whole
from panelcast.llm.tables import forest, rooted, share
from panelcast.sources.tables import materialise

PERMUTATIONS, BANDS, PERCENT = 64, 16, 80
#: Bytes of text in a part of the order, and in a block that a task sends off.
PART_BYTES, BLOCK_BYTES = 12_000_000, 12_000_000
#: Sets of one class in one band before the band is dealt over several tasks.
BAND_PART = 4096
#: Further leaders of a band with several classes, before all pairs across its classes are looked at.
MORE_LEADERS = 4
_A, _B = arrays._odd(41, PERMUTATIONS), arrays._odd(42, PERMUTATIONS)
_LOWEST = -(2**63)


def _shingles(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of the rows (repeats included) and how many each row has."""
    counts = np.diff(first)
    many = np.maximum(counts - WIDTH + 1, np.minimum(counts, 1))
    at, row = arrays.starts_of(first, WIDTH)
    x = np.zeros(many.sum(), np.uint64)
    start = np.cumsum(many) - many
    x[start[row] + at - first[:-1][row]] = arrays.windows(h, WIDTH)[at] if len(at) else 0
    for i in np.flatnonzero((counts > 0) & (counts < WIDTH)).tolist():
        x[start[i]] = whole(h[first[i] : first[i + 1]], counts[i])
    return x, many


def signatures(data: np.ndarray, at: np.ndarray, names: bool = False):
    """(rows, PERMUTATIONS) of 16 bits; and, if asked for, name, size and parities of each row's set."""
    size, odd = np.zeros(len(at) - 1, np.int64), [b""] * (len(at) - 1)
    out, ids = np.full((len(at) - 1, PERMUTATIONS), 0xFFFF, np.uint16), np.zeros(len(at) - 1, np.uint64)
    for a, b in arrays.runs(at, arrays.PIECE_BYTES):
        h, first = arrays.words(data[at[a] : at[b]], at[a : b + 1] - at[a], lower=True)
        x, many = _shingles(h, first)
        full = np.flatnonzero(many)
        if not len(full):
            continue
        start = (np.cumsum(many) - many)[full]
        for k in range(PERMUTATIONS):
            out[a + full, k] = arrays.mix(np.minimum.reduceat(x * _A[k] + _B[k], start)).astype(np.uint16)
        if names:
            for i, s in zip(full.tolist(), start.tolist(), strict=True):
                own = np.sort(x[s : s + many[i]])
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
                ids[a + i], size[a + i], odd[a + i] = xxhash.xxh64_intdigest(own), len(own), parities(own)
    return out, ids, size, odd


def parities(own: np.ndarray) -> bytes:
    """Parities of the members in 2 to 4 buckets a member; where two sets' differ, a member is not shared."""
    power = min(max(6, (2 * len(own) - 1).bit_length()), 16)
    slot = (own * _A[0] >> np.uint64(64 - power)).astype(np.int64)
    return np.packbits((np.bincount(slot, minlength=1 << power) & 1).astype(np.uint8)).tobytes()


def _order_bounds(docs: DataFrame) -> np.ndarray:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, size // PART_BYTES)
    if parts < 2:
        return np.zeros(0, np.int64)
    cuts = docs.stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)
    return np.unique(np.array(cuts, np.float64)).astype(np.int64)


_BLOCK = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("ghost", pa.bool_())])


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, signatures of text, edited text, likenesses and set name."""
    docs = docs.select("doc_id", "text")
    bounds = share(docs.sparkSession, _order_bounds(docs))

    def part_of(ids: pa.Array) -> np.ndarray:
        return np.searchsorted(bounds.value, ids.fill_null(_LOWEST).to_numpy(zero_copy_only=False), "right")

    def tops(batches):
        for batch in batches:
            if batch.num_rows:
                ids = batch.column(0)
                part, value = part_of(ids), ids.fill_null(_LOWEST).to_numpy(zero_copy_only=False)
                uniq, back = np.unique(part, return_inverse=True)
                most = np.full(len(uniq), _LOWEST)
                np.maximum.at(most, back, value)
                yield pa.record_batch([pa.array(uniq), pa.array(most)], ["part", "top"])

    # the first row of each part; a row a part reaches the driver
    top = {p: t for p, t in docs.select("doc_id").mapInArrow(tops, "part long, top long").groupBy("part").agg(F.max("top")).collect()}
    order = sorted(top)
    goes_to = {p: order[(i + 1) % len(order)] for i, p in enumerate(order)}  # the lowest part goes on with the highest
    plan = docs.sparkSession.createDataFrame([(t, goes_to[p]) for p, t in top.items()], "top long, to long")
    first = docs.join(F.broadcast(plan), F.coalesce("doc_id", F.lit(_LOWEST)) == F.col("top")).groupBy("to", "doc_id").agg(
        F.min(F.coalesce("text", F.lit(""))).alias("text")
    )

    def blocks(ids, texts, part, ghost):
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], part[order][1:] != part[order][:-1], [True]))) if len(part) else [0]
        batch = pa.record_batch([ids, texts.cast(pa.string()), pa.array(np.full(len(part), ghost))], schema=_BLOCK).take(pa.array(order))
        rows = [(int(part[order[a]]), _packed(batch.slice(a, b - a))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.record_batch([pa.array([p for p, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["part", "block"])

    def send(batches):
        for batch in batches:
            _, at = arrays.utf8(batch.column(1))
            for a, b in arrays.runs(at, BLOCK_BYTES):
                ids = batch.column(0).slice(a, b - a)
                yield from blocks(ids, batch.column(1).slice(a, b - a), part_of(ids), False)

    def send_first(batches):
        for batch in batches:
            if batch.num_rows:
                yield from blocks(batch.column(1), batch.column(2), batch.column(0).to_numpy(zero_copy_only=False), True)

    def meet(table):
        own, ghost = [], None
        for raw in table["block"].to_pylist():
            for batch in pa.ipc.open_stream(raw):
                for k, text, is_ghost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if is_ghost:
                        ghost = text or ""
                    else:
                        own.append((k, text or ""))
        own.sort(key=lambda r: r[1])
        own.sort(key=lambda r: _LOWEST if r[0] is None else r[0], reverse=True)
        texts = [t for _, t in own]
        after = [*texts[1:], ghost if ghost is not None else texts[0] if texts else ""]
        edited = [t[: len(t) - len(t) // 3] + n[: len(t) // 3] for t, n in zip(texts, after, strict=True)]
        sig, names, size, odd = signatures(*arrays.utf8(pa.array([*texts, after[-1]], pa.string())), names=True)
        other, *_ = signatures(*arrays.utf8(pa.array(edited, pa.string())))
        mine = sig[:-1]
        cuts = np.arange(len(own) + 1)
        return pa.table(
            {
                "doc_id": pa.array([k for k, _ in own], pa.int64()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                "sig": arrays.blobs(mine.astype(">u2"), cuts),
                "edited_sig": arrays.blobs(other.astype(">u2"), cuts),
                "near_edited": pa.array((mine == other).mean(1)),
                "near_next": pa.array((mine == sig[1:]).mean(1)),
                "set_id": pa.array(names[:-1].view(np.int64)),
                "size": pa.array(size[:-1]),
                "odd": pa.array(odd[:-1], pa.binary()),
            }
        )

    kind = "part long, block binary"
    sent = docs.mapInArrow(send, kind).union(first.select("to", "doc_id", "text").mapInArrow(send_first, kind))
    return sent.groupBy("part").applyInArrow(
        meet,
        "doc_id long, n_chars long, edited_sha256 string, sig binary, edited_sig binary, near_edited double, near_next double, set_id long, size long, odd binary",
    )


def shared_bands(table: DataFrame) -> DataFrame:
    """(band, value, set_id, a): the sets of each band that has several, with the least of them."""
    width = 2 * PERMUTATIONS // BANDS
    bands = F.array(*(F.substring("sig", 1 + i * width, width) for i in range(BANDS)))
    sets = table.where("set_id <> 0").groupBy("set_id").agg(F.first("sig").alias("sig"))
    keyed = sets.select("set_id", F.posexplode(bands).alias("band", "value"))
    least = keyed.groupBy("band", "value").agg(F.min("set_id").alias("a"), F.max("set_id").alias("top")).where("a < top")
    return keyed.join(least.drop("top"), ["band", "value"])


def band_pairs(shared: DataFrame) -> DataFrame:
    """(a, b): each set with the least set of each of its bands."""
    return shared.where("a <> set_id").select("a", F.col("set_id").alias("b")).distinct()


def _labelled(sets: DataFrame, state: DataFrame) -> DataFrame:
    of = rooted(state).select(F.col("node").alias("set_id"), F.col("root"))
    return sets.join(of, "set_id", "left").withColumn("label", F.coalesce("root", "set_id")).drop("root")


def more_band_pairs(shared: DataFrame, state: DataFrame) -> DataFrame:
    """(a, b): each set of a band with several classes in *state* with further leaders of other classes."""
    keyed = _labelled(shared.drop("a"), state)
    rank = [F.min(F.struct(F.xxhash64("set_id", "band", F.lit(t)), F.col("set_id").alias("a"), F.col("label").alias("of"))) for t in range(MORE_LEADERS)]
    mixed = keyed.groupBy("band", "value").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.array(*rank).alias("to")).where("lo < hi")
    met = keyed.join(mixed.select("band", "value", "to"), ["band", "value"])
    met = met.select("set_id", F.explode(F.filter("to", lambda x: x["of"] != F.col("label"))).alias("x"))
    return met.select(F.least("x.a", "set_id").alias("a"), F.greatest("x.a", "set_id").alias("b")).distinct()


def open_pairs(size: np.ndarray, label: np.ndarray, odd: list[bytes], hot=None):
    """Index pairs (many, one) of sets with different labels that size and parities leave possible."""
    for power in sorted({len(x) for x in odd}):
        some = [i for i, x in enumerate(odd) if len(x) in (power, 2 * power)]
        some = np.array(sorted(some, key=lambda i: size[i]))
        bits = np.zeros((len(some), power), np.uint8)
        for k, i in enumerate(some.tolist()):
            x = np.frombuffer(odd[i], np.uint8)
            if len(x) > power:
                x = np.packbits(np.bitwise_xor.reduce(np.unpackbits(x).reshape(-1, 2), axis=1))
            bits[k] = x
        bits, n, own = bits.view(np.uint64), size[some], label[some]
        for j in np.flatnonzero([len(odd[i]) == power for i in some.tolist()]).tolist():
            end = np.searchsorted(n, n[j] * 100 // PERCENT, "right")
            good = own[j + 1 : end] != own[j]
            if hot is not None:
                good &= (own[j + 1 : end] == hot) != (own[j] == hot)
            i = j + 1 + np.flatnonzero(good)
            if len(i):
                both = n[i] + n[j]
                need = -(-PERCENT * both // (100 + PERCENT))
                i = i[both - np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64) >= 2 * need]
            if len(i):
                yield some[i], some[j]


class Classes:
    """Classes of numbered items that grow together."""

    def __init__(self, label: np.ndarray):
        _, first, back = np.unique(label, return_index=True, return_inverse=True)
        self.up = first[back].tolist()

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.find(i)] = self.find(j)


def rest_links(docs: DataFrame, table: DataFrame, shared: DataFrame, state: DataFrame) -> DataFrame:
    """(a, b): links of sets that agree in a band and are of different components of *state*.

    Not every link, but enough that the classes of each band are those of all its links.
    """
    keyed = _labelled(shared.drop("a"), state)
    mixed = keyed.groupBy("band", "value").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    rows = materialise(keyed.join(mixed.select("band", "value"), ["band", "value"]))
    named = table.join(rows.select("set_id").distinct(), "set_id", "left_semi")
    facts = named.groupBy("set_id").agg(F.first("size").alias("size"), F.first("odd").alias("odd"))
    count = rows.groupBy("band", "value", "label").agg(F.count("*").alias("n")).where(F.col("n") > BAND_PART)
    hot = count.select("band", "value", F.col("label").alias("hot"), F.ceil(F.col("n") / F.lit(BAND_PART)).cast("int").alias("parts"))
    # the sets of a hot class go to one part each, the other sets of its band to all parts
    part = F.when(F.col("label") == F.col("hot"), F.array(F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int")))
    dealt = rows.join(hot, ["band", "value"]).withColumn("part", F.explode(part.otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    plain = rows.join(hot.select("band", "value", F.col("hot").alias("label")), ["band", "value", "label"], "left_anti")
    columns = ["band", "value", "hot", "part", "set_id", "label"]
    both = plain.withColumns({"hot": F.lit(None).cast("long"), "part": F.lit(0)}).select(columns).union(dealt.select(columns))

    def pairs(group):
        return open_pairs(group["size"].to_numpy(), group["label"].to_numpy(), group["odd"].to_pylist(), group["hot"][0].as_py())

    def able(group):
        met = np.zeros(len(group), bool)
        for i, j in pairs(group):
            met[i] = met[j] = True
        return group.filter(pa.array(met))

    def verified(group):
        name, classes = group["set_id"].to_numpy(), Classes(group["label"].to_numpy())
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group["members"].combine_chunks()]
        left, right = [], []
        for many, j in pairs(group):
            for i in many.tolist():
                if classes.find(i) != classes.find(j):
                    n = common(sets[i], sets[j])
                    if 100 * n >= PERCENT * (len(sets[i]) + len(sets[j]) - n):
                        classes.join(i, j)
                        left.append(name[i])
                        right.append(name[j])
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    groups = ("band", "value", "hot", "part")
    kind = "band int, value binary, hot long, part int, set_id long, label long, size long, odd binary"
    some = both.join(facts, "set_id").select(*columns, "size", "odd").groupBy(*groups).applyInArrow(able, kind)
    some = materialise(some)
    members = needed_sets(docs, some.select("set_id").distinct())
    return some.join(members, "set_id").groupBy(*groups).applyInArrow(verified, "a long, b long")


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row for each row of *docs*: the edited-text test, fingerprints in hexadecimal, near_id.

    near_id is the least doc_id of the row's class of near duplicates.
    """
    table = materialise(with_next(docs))
    least = table.where("set_id <> 0").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    # most bands have one set: what follows reads the others only
    shared = materialise(shared_bands(table))
    state = forest(_linked(docs, band_pairs(shared)))
    state = forest(_linked(docs, more_band_pairs(shared, state)), state)
    state = forest(rest_links(docs, table, shared, state), state)
    of = least.join(rooted(state).withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    near = of.join(of.groupBy("root").agg(F.min("least").alias("near_id")), "root").select("set_id", "near_id")
    hex_ = lambda c: F.lower(F.hex(c))
    return table.join(near, "set_id", "left").select(
        "doc_id", "n_chars", "edited_sha256", hex_("sig").alias("fingerprint"), hex_("edited_sig").alias("edited_fingerprint"),
        "near_edited", "near_next", "near_id",
    )


def _linked(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    pairs = materialise(pairs)
    names = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    return linked(pairs, needed_sets(docs, names), PERCENT)
