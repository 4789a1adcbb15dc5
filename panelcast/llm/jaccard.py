"""Exact n-gram Jaccard join by set-relation skipping.

Sets are those of :mod:`panelcast.llm.shingles`; two documents link when their sets share at least
*percent* of their union.  Equal sets are one set from the start.

1. Answers from a similar set: a key is three min-hashes, and each set is compared with one of the sets
   that have the same key, their leader; a set has a leader for each of its keys.  A set that links
   with a leader belongs to its component; within a component no pair is looked for again.  Large
   groups get a few leaders more, for the sets whose component is another.  This is linear in the
   size of a group of near copies.
2. Index lists: all shingles are counted, rare ones lead.  A set enters the lists of its prefix, with
   the position it holds there; a shingle that no other set has needs no list.  A list is grouped
   into blocks by position, each sorted by size: a probe skips every block whose positions leave too
   few shingles for a link, and within a block all sizes that cannot reach it.  Entries carry 256
   parities of their set: where two differ, at least one shingle is not shared, which rules out more.
3. What leaves a list at first are pairs of leaders (a set without one leads itself), once however
   many members meet.  They are compared exactly.  The answers of members follow from them: members a
   and b share at most what their leaders share, plus what each has beyond its leader.  A member with
   nothing beyond (a cut copy) is smaller, so it may link where its leader does not.  Where no member
   of either can reach the bound, none is looked at; pairs that it leaves open go through the lists
   once more and are compared exactly.
4. The components of all links are formed.

No list or group is cut short.  The list of a shingle where one component has very many entries is
dealt over several tasks: its entries are split, the few others are sent to each.
Nulls and empty texts: no set, linked with nothing, component_id is the own doc_id.  Repeated rows
have equal sets and share a component.  A null doc_id takes part with its text; it never is the least
id.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import arrays
from panelcast.llm.shingles import compared, needed_sets, sets_of, signed
from panelcast.llm.tables import bit_set, bucket_bits, forest, rooted, share
from panelcast.sources.tables import materialise

PERCENT = 80
KEYS, KEY_WIDTH = 8, 3
#: Groups of more sets than this get so many leaders more.
LARGE, MORE_LEADERS = 8, 4
#: Parities of a set: words of 64 bits; they only rule out.
PARITIES = ("p0", "p1", "p2", "p3")
#: Shingles of the highest counts whose order is refined by their counts; a broadcast of 1.2 MB.
MOST_HEAVY = 1 << 17
#: Entries of one component in one list before the list is dealt over several tasks.
LIST_PART = 4096
FLUSH = 2_000_000
_SEEDS = arrays._odd(31, KEYS)


def _run_sets(batch, column: int = 1):
    """Lists of (row, name, set) of about a run's size."""
    held, n = [], 0
    for item in sets_of(batch.column(column)):
        held.append(item)
        n += len(item[2])
        if n > 200_000:
            yield held
            held, n = [], 0
    if held:
        yield held


def set_table(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_id, keys) of every row; keys is empty for an empty set."""

    def body(batches):
        for batch in batches:
            ids = batch.column(0)
            for held in _run_sets(batch):
                size = np.array([len(x) for _, _, x in held])
                members = np.concatenate([x for _, _, x in held])
                full = np.flatnonzero(size)
                keys = np.zeros((KEYS, len(full)), np.uint64)
                if len(full):
                    at = np.cumsum(size[full]) - size[full]
                    for k in range(KEYS):
                        keys[k] = np.minimum.reduceat(members * _SEEDS[k] ^ _SEEDS[k - 1], at)
                    keys = sum(np.roll(keys, -i, axis=0) * _SEEDS[i] for i in range(KEY_WIDTH))
                cuts = np.concatenate(([0], np.cumsum(KEYS * (size > 0)))).astype(np.int32)
                yield pa.record_batch(
                    [
                        ids.slice(held[0][0], len(held)),
                        pa.array(size.astype(np.int64)),
                        pa.array(signed([name for _, name, _ in held])),
                        pa.ListArray.from_arrays(cuts, pa.array(keys.T.reshape(-1).view(np.int64))),
                    ],
                    ["doc_id", "n_shingles", "set_id", "keys"],
                )

    return docs.select("doc_id", "text").mapInArrow(body, "doc_id long, n_shingles long, set_id long, keys array<long>")


def leader_pairs(classes: DataFrame) -> DataFrame:
    """(a, b): every set with one leader of each of its key groups, the first by a hash."""
    keyed = classes.select("set_id", F.posexplode("keys").alias("k", "key"))
    rank = F.struct(F.xxhash64("set_id", "k"), "set_id")
    leaders = keyed.groupBy("k", "key").agg(F.min(rank).getField("set_id").alias("a"), F.count("*").alias("n")).where("n > 1")
    pairs = keyed.join(leaders.select("k", "key", "a"), ["k", "key"]).where("a <> set_id")
    return pairs.select("a", F.col("set_id").alias("b")).distinct()


def more_leader_pairs(classes: DataFrame, state: DataFrame) -> DataFrame:
    """(a, b): every set of a large key group with further leaders of it that have another label in *state*."""
    keyed = _labelled(classes.select("set_id", F.posexplode("keys").alias("k", "key")), state)
    rank = [F.min(F.struct(F.xxhash64("set_id", "k", F.lit(t)), F.col("set_id").alias("a"), F.col("label").alias("of"))) for t in range(MORE_LEADERS)]
    groups = keyed.groupBy("k", "key").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.array(*rank).alias("to"))
    groups = groups.where((F.col("n") > LARGE) & (F.col("lo") < F.col("hi"))).select("k", "key", "to")
    met = keyed.join(groups, ["k", "key"])
    met = met.select("set_id", F.explode(F.filter("to", lambda x: x["of"] != F.col("label"))).alias("x"))
    return met.select("x.a", F.col("set_id").alias("b")).distinct()


def shared_shingles(docs: DataFrame, bits: int) -> DataFrame:
    """(x, n): leading bits of every shingle that two sets or more have, and how many."""

    def packed(held):
        value, n = np.unique(np.concatenate(held) >> np.uint64(32 - bits), return_counts=True)
        edges = np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32)
        more = n > 1
        low = value & np.uint64(0xFFFFFFFF)
        extra = np.stack((low[more], n[more].astype(np.uint64) - np.uint64(1)), axis=1).astype(np.uint32)
        return pa.record_batch(
            [
                pa.array(np.arange(1 << bits, dtype=np.int32)),
                arrays.blobs(low.astype(np.uint32), np.searchsorted(value, edges)),
                arrays.blobs(extra, np.searchsorted(value[more], edges)),
            ],
            ["bucket", "once", "extra"],
        )

    def send(batches):
        held, n, seen = [], 0, set()
        for batch in batches:
            for _, name, x in sets_of(batch.column(0)):
                if len(x) and name not in seen:
                    seen.add(name)
                    held.append(x)
                    n += len(x)
                if n >= FLUSH:
                    yield packed(held)
                    held, n, seen = [], 0, set()
        if n:
            yield packed(held)

    def meet(table):
        once = np.frombuffer(b"".join(table["once"].to_pylist()), np.uint32)
        extra = np.frombuffer(b"".join(table["extra"].to_pylist()), np.uint32).reshape(-1, 2)
        value, n = np.unique(once, return_counts=True)
        np.add.at(n, np.searchsorted(value, extra[:, 0]), extra[:, 1].astype(np.int64))
        many = n > 1
        bucket = table["bucket"][0].as_py() if table.num_rows else 0
        return pa.table({"x": pa.array(value[many].astype(np.int64) + (bucket << 32)), "n": pa.array(n[many].astype(np.int64))})

    sent = docs.select("text").mapInArrow(send, "bucket int, once binary, extra binary")
    return sent.groupBy("bucket").applyInArrow(meet, "x long, n long")


def _heavy(shared: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of the highest counts and the logarithms of these, MOST_HEAVY at most."""
    power = F.floor(F.log2("n")).cast("int")
    sizes = dict(shared.where("n >= 16").groupBy(power.alias("p")).count().collect())
    total, least = 0, 64
    for p in sorted(sizes, reverse=True):
        total += sizes[p]
        if total > MOST_HEAVY:
            break
        least = p
    rows = shared.where(F.col("n") >= F.lit(1 << min(least, 62))).select("x", power.alias("p")).toPandas()
    rows = rows.sort_values("x")
    return rows["x"].to_numpy(np.int64).astype(np.uint64), rows["p"].to_numpy(np.uint8)


def index_lists(docs: DataFrame, shared: DataFrame, bits: int, percent: int) -> DataFrame:
    """(x, place, size, set_id, PARITIES): the lists that sets enter with their prefixes."""
    known = share(docs.sparkSession, (bit_set(shared.select("x"), shared.count()), *_heavy(shared)))

    def body(batches):
        some, heavy, power = known.value
        seen: set[int] = set()
        for batch in batches:
            for held in _run_sets(batch, 0):
                held = [(name, x) for _, name, x in held if len(x) and not (name in seen or seen.add(name))]
                if not held:
                    continue
                size = np.array([len(x) for _, x in held])
                top = np.concatenate([x for _, x in held]) >> np.uint64(32 - bits)
                rank = some.has(top).astype(np.uint8)
                at = np.flatnonzero(rank)
                if len(heavy):
                    i = np.minimum(np.searchsorted(heavy, top[at]), len(heavy) - 1)
                    rank[at] += np.where(heavy[i] == top[at], power[i], 0).astype(np.uint8)
                start = np.cumsum(size) - size
                own = size - np.add.reduceat((rank > 0).astype(np.int64), start)
                prefix = size + (-percent * size // 100) + 1
                cell = np.repeat(np.arange(len(held)) << 8, size) + (np.concatenate([x for _, x in held]) * _SEEDS[0] >> np.uint64(56)).astype(np.int64)
                odd = np.packbits((np.bincount(cell, minlength=len(held) << 8) & 1).astype(np.uint8)).view(np.int64).reshape(-1, len(PARITIES))
                out = []
                for j in np.flatnonzero(own < prefix).tolist():
                    a, n, p = start[j], size[j], prefix[j]
                    order = np.argsort(rank[a : a + n], kind="stable")[own[j] : p]
                    x = top[a : a + n][order]
                    out.append((x, np.arange(own[j], p), np.full(len(x), n), np.full(len(x), held[j][0], np.uint64), np.full(len(x), j)))
                if out:
                    x, place, n, name, j = (np.concatenate(c) for c in zip(*out, strict=True))
                    yield pa.record_batch(
                        [pa.array(x.astype(np.int64)), pa.array(place.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(name.view(np.int64)), *(pa.array(c) for c in odd[j].T.copy())],
                        ["x", "place", "size", "set_id", *PARITIES],
                    )

    # a set whose copies lie in several tasks enters each list once
    return docs.select("text").mapInArrow(body, "x long, place int, size int, set_id long, " + ", ".join(f"{p} long" for p in PARITIES)).dropDuplicates(["x", "set_id"])


def list_pairs(place, size, label, odd, hot, percent: int):
    """Index pairs (many, one) of one list that may link: blocks by position, sorted by size within."""
    order = np.lexsort((size, place >> 3))
    place, size, label, odd = place[order], size[order].astype(np.int64), label[order], odd[order]
    block = place >> 3
    cuts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True])))
    for j in range(len(size)):
        n = size[j]
        furthest = n - -(-2 * percent * n // (100 + percent))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if block[a] << 3 > furthest:
                break  # this block and all after it leave too few shingles
            lo = a + np.searchsorted(size[a:b], -(-percent * n // 100))
            hi = a + np.searchsorted(size[a:b], n, "right")
            if lo >= hi:
                continue
            s = size[lo:hi]
            need = -(-percent * (s + n) // (100 + percent))
            good = (label[lo:hi] != label[j]) & (s - place[lo:hi] >= need) & (n - place[j] >= need)
            if hot is not None:
                good &= (label[lo:hi] == hot) != (label[j] == hot)
            i = np.flatnonzero(good)
            if len(i):  # a parity that differs is a shingle of one set only
                i = i[s[i] + n - np.bitwise_count(odd[lo + i] ^ odd[j]).sum(1, dtype=np.int64) >= 2 * need[i]]
            if len(i):
                yield order[lo + i], order[j], need[i]


def candidate_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of different labels that the lists cannot rule out.

    *rows*: the lists with each set's leader, what it has beyond (extra) and its component (label).
    Without a column ``open``: pairs of leaders.  With it, a map from leaders to common shingles: pairs
    of sets whose leaders are in it and leave the link possible.
    """
    last = "open" in rows.columns
    carried = ["x", "place", "size", "set_id", "label", "leader", "extra", *PARITIES, *["open"] * last]
    parts = F.ceil(F.col("n") / F.lit(LIST_PART)).cast("int")
    hot = rows.groupBy("x", "label").agg(F.count("*").alias("n")).where(F.col("n") > LIST_PART).select("x", F.col("label").alias("hot"), parts.alias("parts"))
    # the rows of a hot label go to one part each, the other rows of its list to all parts
    dealt = rows.join(hot, "x").select(
        *carried, "hot",
        F.explode(
            F.when(F.col("label") == F.col("hot"), F.array(F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int")))
            .otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
        ).alias("part"),
    )
    plain = rows.join(hot.withColumnRenamed("hot", "label").select("x", "label"), ["x", "label"], "left_anti")
    both = plain.select(*carried, F.lit(None).cast("long").alias("hot"), F.lit(0).alias("part")).union(
        dealt.select(*carried, "hot", "part")
    )
    keys = ["x", "hot", "part"]

    def body(batches):
        def pairs(batch):
            hots = batch.column(1)
            hot = hots.fill_null(0).to_numpy(zero_copy_only=False)
            plain = hots.is_null().to_numpy(zero_copy_only=False)
            x, part, place, size, name, label, leader, extra, *odd = (
                batch.column(i).to_numpy(zero_copy_only=False) for i in (0, *range(2, 9 + len(PARITIES)))
            )
            odd = np.stack(odd, axis=1).view(np.uint64)
            change = np.zeros(len(x) - 1, bool)
            for key in (x, hot, plain, part):
                change |= key[1:] != key[:-1]
            cuts = np.flatnonzero(np.concatenate(([True], change, [True])))
            mixed = np.minimum.reduceat(label, cuts[:-1]) != np.maximum.reduceat(label, cuts[:-1])
            left, right = [], []
            for k in np.flatnonzero(mixed):
                a, b = cuts[k], cuts[k + 1]
                known = [dict(m) for m in batch.column(9 + len(PARITIES)).slice(a, b - a).to_pylist()] if last else None
                for i, j, need in list_pairs(place[a:b], size[a:b], label[a:b], odd[a:b], hots[int(a)].as_py(), percent):
                    if last:
                        most = np.array([known[j].get(r, -(2**31)) for r in leader[a:b][i].tolist()])
                        i = i[most + extra[a:b][i] + extra[a + j] >= need]
                        left.append(name[a:b][i])
                        right.append(np.full(len(i), name[a + j]))
                    else:
                        own = np.unique(leader[a:b][i])
                        left.append(own)
                        right.append(np.full(len(own), leader[a + j]))
            if left:
                u, v = np.concatenate(left), np.concatenate(right)
                u, v = np.unique(np.stack((np.minimum(u, v), np.maximum(u, v))), axis=1)
                yield pa.record_batch([pa.array(u), pa.array(v)], ["a", "b"])

        rest = None
        for batch in batches:
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            key = [batch.column(i)[-1].as_py() for i in range(3)] if batch.num_rows else None
            if key is None:
                continue
            end = batch.num_rows  # the last list may go on in the next batch
            x = batch.column(0).to_numpy(zero_copy_only=False)
            start = int(np.searchsorted(x != key[0], False)) if x[0] == key[0] else int(np.flatnonzero(x != key[0])[-1]) + 1
            if start:
                yield from pairs(batch.slice(0, start))
            rest = batch.slice(start, end - start)
        if rest is not None and rest.num_rows:
            yield from pairs(rest)

    columns = [*keys, "place", "size", "set_id", "label", "leader", "extra", *PARITIES, *["open"] * last]
    placed = both.select(columns).repartition(*keys).sortWithinPartitions(*keys)
    return placed.mapInArrow(body, "a long, b long").where("a <> b").distinct()


def jaccard_join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of *docs*."""
    docs = docs.select("doc_id", "text")
    table = materialise(set_table(docs))
    classes = materialise(
        table.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"), F.first("keys").alias("keys"))
    )
    star = materialise(_compared(docs, leader_pairs(classes), percent))
    # one round labels nearly all sets of a component alike; where it does not, more pairs are compared
    state = forest(star.where("ok"), rounds=1)
    more = materialise(_compared(docs, more_leader_pairs(classes, state), percent))
    state = forest(more.where("ok"), state)
    star = star.union(more)
    bits = bucket_bits(docs)
    shared = materialise(shared_shingles(docs, bits))
    # each set's leader, and how many shingles it has beyond
    led = star.where("ok").groupBy(F.col("b").alias("set_id")).agg(F.max(F.struct("common", "a", "size_b")).alias("m"))
    led = led.select("set_id", F.col("m.a").alias("leader"), (F.col("m.size_b") - F.col("m.common")).alias("extra"))
    lists = index_lists(docs, shared, bits, percent).join(led, "set_id", "left")
    lists = materialise(lists.withColumns({"leader": F.coalesce("leader", "set_id"), "extra": F.coalesce("extra", F.lit(0)).cast("int")}))
    met = materialise(_compared(docs, candidate_pairs(_labelled(lists, state), percent), percent))
    state = forest(met.where("ok"), state)
    # pairs of leaders whose members may still link
    # a set's slack: what it adds to (100 + percent) * common - percent * (both sizes); a leader alone has its answer
    slack = F.max((100 + percent) * F.col("extra").cast("long") - percent * F.col("size").cast("long"))
    far = lists.groupBy("leader").agg(slack.alias("slack"), F.max((F.col("set_id") != F.col("leader")).cast("int")).alias("leads"))
    side = lambda c: far.select(F.col("leader").alias(c), F.col("slack").alias(f"slack_{c}"), F.col("leads").alias(f"leads_{c}"))
    open_ = met.where("not ok").join(side("a"), "a").join(side("b"), "b")
    reach = (100 + percent) * F.col("common") + F.col("slack_a") + F.col("slack_b") >= 0
    open_ = open_.where((F.col("leads_a") + F.col("leads_b") > 0) & reach)
    open_ = materialise(open_.select("a", "b", F.col("common").cast("int").alias("common")))
    if not open_.isEmpty():
        both = open_.union(open_.select("b", "a", "common")).groupBy(F.col("a").alias("leader"))
        both = both.agg(F.map_from_entries(F.collect_list(F.struct("b", "common"))).alias("open"))
        rest = candidate_pairs(_labelled(lists.join(both, "leader"), state), percent)
        state = forest(_compared(docs, rest, percent).where("ok"), state)
    least = rooted(state).join(classes.select(F.col("set_id").alias("node"), "least"), "node")
    named = least.join(least.groupBy("root").agg(F.min("least").alias("component")), "root").select("node", "component")
    of_set = classes.join(named.withColumnRenamed("node", "set_id"), "set_id", "left").select(
        "set_id", F.coalesce("component", "least").alias("component")
    )
    found = table.where("n_shingles > 0").join(of_set, "set_id", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).union(
        table.where("n_shingles = 0").select("doc_id", "n_shingles", "doc_id")
    )


def _labelled(sets: DataFrame, state: DataFrame) -> DataFrame:
    """*sets* with a label that only sets of one component of *state* share."""
    label = state.groupBy(F.col("a").alias("set_id")).agg(F.min("b").alias("root"))
    return sets.join(label, "set_id", "left").withColumn("label", F.coalesce("root", "set_id")).drop("root")


def _compared(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """*pairs* with common, size_a, size_b, and whether they link."""
    pairs = materialise(pairs)
    names = materialise(pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct())
    union = F.col("size_a") + F.col("size_b") - F.col("common")
    return compared(pairs, needed_sets(docs, names)).withColumn("ok", 100 * F.col("common") >= percent * union)
