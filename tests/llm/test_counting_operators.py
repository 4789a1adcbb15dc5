"""Language-model scores, spelling variants and collocations against brute force on small tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("panelcast.llm")
from panelcast.llm import collocations, lookup, scoring, spelling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, word string, n string"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    stems = ["".join(rng.choices("abcdéfÉghoXß", k=rng.randint(1, 9))) for _ in range(60)]
    prose = lambda n: "".join(rng.choice(stems) + rng.choice((" ", " ", " ", ", ", "\n", ". ", "\t", "-")) for _ in range(n))
    texts = [prose(rng.randint(1, 160)) for _ in range(80)]
    texts += [texts[3]] * 24 + [None, "", " \n", "one", "Ünder ÷ × ſ", "x" * 5000 + " and", prose(9000), "a.b,c;d", "\x0b\x0c \r", "a\x1cb c"]
    out = [(i, t, ["en", None, "und", "fr"][i % 4], "s", None, "c", "w", "n") for i, t in enumerate(texts)]
    return [*out, out[3], (None, prose(40), "en", "s", 1, "c", "w", "n"), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(lookup, "CHUNK_BYTES", 9000)


def _tokens(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(ASCII)) if w] + ["</s>"]


def _fold(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10


def _counted(rows, keep):
    one, two, three = Counter(), Counter(), Counter()
    for r in rows:
        if keep(_fold(r[0])):
            t = ["<s>", "<s>", *_tokens(r[1])]
            one.update(t[2:])
            one["<s>"] += 1
            two.update(zip(t[:-1], t[1:], strict=True))
            three.update(zip(t[:-2], t[1:-1], t[2:], strict=True))
    return one, two, three, sum(n for w, n in one.items() if w != "<s>")


def _estimates(counts, u, v, w):
    one, two, three, n = counts
    context, before = two[u, v], one[v]
    f = three[u, v, w] / max(context, 1), two[v, w] / max(before, 1), one[w] / max(n, 1)
    return (*f, context.bit_length(), before.bit_length())


def _trained(rows, uniform):
    counts = _counted(rows, lambda k: k not in (0, 9))
    found = []
    for r in rows:
        if _fold(r[0]) == 9:
            t = ["<s>", "<s>", *_tokens(r[1])]
            found += [_estimates(counts, *x) for x in zip(t[:-2], t[1:-1], t[2:], strict=True)]
    w3, w2, w1, last = defaultdict(lambda: 0.5, {0: 0.0}), defaultdict(lambda: 0.5, {0: 0.0}), 0.9, None
    for _ in range(scoring.MOST_ROUNDS):
        s = defaultdict(float)
        for f3, f2, f1, b3, b2 in found:
            a, b = w3[b3], w2[b2]
            parts = a * f3, (1 - a) * b * f2, (1 - a) * (1 - b) * w1 * f1, (1 - a) * (1 - b) * (1 - w1) * uniform
            p = sum(parts)
            for key, x in (((3, b3), parts[0] / p), ((3, b3, "all"), 1), ((2, b2), parts[1] / p), ((2, b2, "all"), 1 - parts[0] / p), (1, parts[2] / p), (0, parts[3] / p), ("ll", math.log(p))):
                s[key] += x
        for level, w in ((3, w3), (2, w2)):
            for k in range(1, 64):
                w[k] = s[level, k] / (s[level, k, "all"] + 1) if (level, k, "all") in s else w[k - 1] if k > 1 else 0.5
        w1 = s[1] / (s[1] + s[0] + 1)
        if last is not None and s["ll"] / len(found) - last < scoring.ENOUGH:
            break
        last = s["ll"] / len(found)
    return w3, w2, w1


def test_scores_equal_brute_force(docs, rows, small_chunks):
    counts = _counted(rows, lambda k: k != 0)
    one, _, _, n = counts
    v = sum(1 for w, c in one.items() if c and w != "<s>")
    w3, w2, w1 = _trained(rows, 1 / (v + 1))
    want = []
    for r in rows:
        t = ["<s>", "<s>", *_tokens(r[1])]
        base = sum(math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t[2:])
        score = 0.0
        for x in zip(t[:-2], t[1:-1], t[2:], strict=True):
            f3, f2, f1, b3, b2 = _estimates(counts, *x)
            score += math.log10(w3[b3] * f3 + (1 - w3[b3]) * (w2[b2] * f2 + (1 - w2[b2]) * (w1 * f1 + (1 - w1) / (v + 1))))
        want.append((r[0] is not None, r[0] or 0, _fold(r[0]) == 0, len(t) - 2, sum(one[w] > 0 for w in t[2:]), n, base, score))
    got = [(x.doc_id is not None, x.doc_id or 0, *x[1:]) for x in scoring.score(docs).collect()]
    got, want = sorted(got), sorted(want)
    assert [x[:6] for x in got] == [x[:6] for x in want]
    assert np.allclose([x[6:] for x in got], [x[6:] for x in want], rtol=1e-9)
    held = [x for x in got if x[2]]
    assert sum(x[7] for x in held) > sum(x[6] for x in held)  # the model explains held-out texts better


def test_scores_without_training_rows(spark, empty):
    assert scoring.score(empty).collect() == []
    held = next(k for k in range(99) if _fold(k) == 0)
    (row,) = scoring.score(spark.createDataFrame([(held, "some words")], "doc_id long, text string")).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (True, 3, 0, 0, 0.0, 0.0)


def test_squeezed_arrays_come_back():
    x = np.sort(np.random.default_rng(1).integers(0, 2**63, 999, dtype=np.uint64))
    for y in (x, x[:1], x[:0]):
        assert (lookup.unsqueeze_sorted(lookup.squeeze_sorted(y)) == y).all()
        assert (lookup.unsqueeze(lookup.squeeze(y)) == y).all()


def _registered(rows):
    con = duckdb.connect()
    con.register("t", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "lang": pa.array([r[2] for r in rows], pa.string())}))
    con.execute("CREATE TABLE documents AS SELECT * FROM t")
    return con


def _variant_words(rows):
    n = Counter()
    for r in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            w = w.translate(ASCII)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def _edited(w):
    yield from (w[:i] + w[i + 1 :] for i in range(len(w)))
    for x in [*"abcdefghijklmnopqrstuvwxyz", *map(chr, range(0xC0, 0x100))]:
        yield from (w[:i] + x + w[i:] for i in range(len(w) + 1))
        yield from (w[:i] + x + w[i + 1 :] for i in range(len(w)))


@pytest.fixture(scope="module")
def spelled():
    rng, out = random.Random(9), []
    words = ["".join(rng.choices("abcé", k=rng.randint(5, 9))) for _ in range(80)] + ["longword" * 9, "longword" * 9 + "s", "xongword" + "longword" * 8]
    words += [rng.choice(list(_edited(rng.choice(words)))) for _ in range(250)]
    for i in range(160):
        out.append((i, " ".join(w if rng.random() < 0.5 else w.upper() for w in rng.choices(words, weights=[1 / (1 + k % 40) for k in range(len(words))], k=120)), None))
    return [*out, (None, "abcabc aBcabc", None), (7, None, None), (8, "", None), out[0]]


@pytest.mark.parametrize("long, limit", [(512, 32), (2, 4), (1, 1 << 40)])
def test_variants_equal_brute_force(spark, monkeypatch, spelled, long, limit):
    monkeypatch.setattr(spelling, "LONG", long)
    monkeypatch.setattr(spelling, "LEAST_LIMIT", limit)
    n = _variant_words(spelled)
    near = {w: {x for x in _edited(w) if x != w and x in n} for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    want = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        want.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    frame = spark.createDataFrame([(*r, "clash") for r in spelled], "doc_id long, text string, lang string, word string").repartition(3)
    got = [tuple(x) for x in spelling.variants(frame).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(x[1] is not None for x in want) > 20 and any(len(x[0]) > spelling.WIDE and x[4] for x in want)


def test_variants_sql_and_empty(spark, docs, rows, spelled, empty):
    assert spelling.variants(empty).collect() == []
    frame = spark.createDataFrame(spelled, "doc_id long, text string, lang string")
    for df, table in ((frame, spelled), (docs, rows)):
        want = _registered(table).execute(spelling.SQL).fetchall()
        assert sorted(map(tuple, spelling.variants(df).collect()), key=str) == sorted(want, key=str)


def test_crc_of_stretches():
    words = [b"", b"a", b"abc" * 40, "é".encode(), b"z" * 64, b"y" * 65]
    ends = np.cumsum([len(w) for w in words])
    data = np.frombuffer(b"".join(words), np.uint8)
    state = np.array([zlib.crc32(b"%d:" % i) for i in range(len(words))], np.uint32)
    got = spelling._crc32(data, ends - [len(w) for w in words], ends, state)
    assert got.tolist() == [zlib.crc32(b"%d:" % i + w) for i, w in enumerate(words)]


@pytest.mark.parametrize("k, width", [(2, 16), (3, 21), (5, 17), (5, 25), (4, 40), (5, 64)])
def test_filters_are_lossless(k, width):
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 2 ** min(width, 63), (k, 500), dtype=np.uint64)
    ids[:, 100:200] = ids[:, :100]
    p = collocations.Packing(k, width)
    assert (p.ids(p.permuted(ids)) == ids).all()
    limbs, n = p.added(p.permuted(ids), np.ones(500, np.int64))
    want = Counter(map(tuple, ids.T.tolist()))
    parts = [p.opened(f[0], 5, *f[1:]) for f in p.filters(limbs, n, 5)]
    got = {}
    for x, c in parts:
        got |= dict(zip(map(tuple, p.ids(x).T.tolist()), c.tolist(), strict=True))
    assert got == want


def _collocated(rows, least, top):
    n, f = Counter(), Counter()
    for r in rows:
        lang = r[2] or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r[1] or "").translate(ASCII)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    f = {p: c for p, c in f.items() if c >= least}
    out = defaultdict(list)
    for p, a in f.items():
        if len(p) > 2:
            lang, *w = p
            l, r, score = min(((f[lang, *w[:k]], f[lang, *w[k:]], 1000 * a * n[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]])) for k in range(1, len(w))), key=lambda x: x[2])
            inside = any(q[0] == lang and len(q) > len(p) and b >= a and any(list(q[i : i + len(w)]) == w for i in range(1, len(q))) for q, b in f.items())
            if not inside:
                out[lang].append((" ".join(w), a, l, r, n[lang], score))
    for lang, x in out.items():
        x.sort(key=lambda y: (-y[5], -y[1], y[0].encode()))
        yield from ((lang, i, *y) for i, y in enumerate(x[:top], 1))


@pytest.mark.parametrize("least, top", [(5, 40), (3, 10**6)])
def test_collocations_equal_brute_force(docs, rows, small_chunks, least, top):
    want = sorted(_collocated(rows, least, top))
    assert len({x[0] for x in want}) >= 2 and any(x[2].count(" ") > 1 for x in want)
    assert sorted(map(tuple, collocations.collocations(docs, least, top).collect())) == want


def test_collocations_sql_and_empty(spark, empty):
    assert collocations.collocations(empty).collect() == []
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["Über", "a", "b", "c d", "x.", "f"], k=120)), rng.choice(["en", None])) for i in range(200)]
    want = _registered(rows).execute(collocations.SQL).fetchall()
    got = collocations.collocations(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(want) > 20 and sorted(map(tuple, got)) == sorted(want)
