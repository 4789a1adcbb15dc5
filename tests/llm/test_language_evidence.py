"""Language evidence of pages and documents against brute force."""

import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("panelcast.llm")
from panelcast.llm import arrays, language, queries

WORDS = {"de": "der und die das ung keit nicht zu", "en": "the and of that ing er tion with"}


def write(spark, path, documents, pages):
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")


def test_pages_have_rows_by_suffix_host_and_domain(spark, tmp_path):
    rng = random.Random(2)
    prose = lambda x, n: " ".join(rng.choices(WORDS[x].split(), k=n))
    documents = [(i, prose(x, 30), x, "s" + x, None) for i, x in enumerate(["de", "en"] * 15)]
    pages = [(i, f"https://{h}.{d}/{i}", f"<html lang='{x}'><p>{prose(x, 20)}</p></html>") for i, (x, h, d) in enumerate([("de", "a", "example.de"), ("en", "b", "site.com"), ("de", "c", "site.com")] * 8)]
    pages += [(100, "https://a.example.de/x", "<p>der the</p>"), (101, "https://new.example.de/x", "<p>zu of</p>"), (102, "https://b.site.com/", "<p>der the</p>"), (103, "https://y.other.de", "<p>er</p>"), (104, None, "<p>die das</p>")]
    write(spark, tmp_path, documents, pages)
    got = {(r.kind, r.doc_id): r for r in queries.op9_language_fusion(spark, str(tmp_path)).collect()}
    assert Counter(k for k, _ in got) == {"document": len(documents), "page": len(pages)}

    records = language.document_records(spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long"))
    records = records.unionByName(language.page_records(spark.createDataFrame(pages, "page_id long, url string, html string"))).collect()
    names, keys = ["de", "en"], ("declared", "suffix", "host", "domain")
    slots = [language._slots(*arrays.utf8(pa.array([r.text])))[0] for r in records]
    counts = np.zeros((2, language.SLOTS))
    for r, s in zip(records, slots, strict=True):
        if r.declared:
            np.add.at(counts[names.index(r.declared)], s, 1)
    model = language.text_models(counts)
    scores = [[language.TEMPER * row[s].sum() for row in model] for s in slots]
    best = [int(np.argmax(x)) if len(s) and max(x) > x[2] else None for x, s in zip(scores, slots, strict=True)]
    best = [None if b == 2 else b for b in best]
    seen = {k: defaultdict(lambda: [0, 0]) for k in keys}
    for r, b in zip(records, best, strict=True):
        for k in keys:
            if r[k] is not None:
                seen[k][r[k]]
                if b is not None:
                    seen[k][r[k]][b] += 1
    total = [best.count(i) for i in (0, 1)]
    for r, b, score in zip(records, best, scores, strict=True):
        logs = []
        for i in (0, 1):
            p = (total[i] + 1) / (sum(total) + 2)
            for k in ("domain", "host"):
                if r[k] is not None:
                    n = [seen[k][r[k]][j] - (b == j) for j in (0, 1)]
                    p = (n[i] + language.STRENGTH * p) / (sum(n) + language.STRENGTH)
            x = score[i] + math.log(p)
            if r.declared is not None:  # counts as further records that say the same
                more = language.DECLARED
                x += math.log((seen["declared"][r.declared][i] + 1 + more * (names[i] == r.declared)) / (total[i] + 3 + more))
            if r.suffix is not None:
                x += math.log((seen["suffix"][r.suffix][i] + 1) / (total[i] + 3))
            logs.append(x)
        logs.append(score[2] + math.log(1 / 3) * (1 + (r.declared is not None) + (r.suffix is not None)))
        weight = sum(math.exp(x - max(logs)) for x in logs)
        row = got[r.kind, r.doc_id]
        assert row.posterior == pytest.approx(1 / weight)
        assert row.lang == [*names, None][int(np.argmax(logs))]


@pytest.mark.parametrize("n", [1, 9, 10, 11])
def test_rare_languages_keep_their_documents_in_large_and_small_tables(spark, n):
    rng = random.Random(4)
    rare = "tak niet het een van zijn voor deze".split()
    prose = lambda w, k: " ".join(rng.choices(w, k=k))
    rows = [(i, prose(rare, 30), "nl", "s", 1) for i in range(n)]
    if n % 2:
        rows += [(1000 + i, prose(WORDS[x].split(), 30), x, "s", 1) for i, x in enumerate(["de", "en"] * 30)]
    rows += [(5000, "", "nl", "s", 1), (5001, "日本語の文章です" * 30, None, None, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in language.identify(language.document_records(frame)).collect()}
    assert all(got[i].kept and got[i].lang == "nl" for i in range(n))
    assert all(got[r[0]].lang == r[2] for r in rows if 1000 <= r[0] < 5000)
    assert not got[5000].kept and not got[5001].kept
    assert all(0 < r.posterior <= 1 for r in got.values())


def test_without_declared_languages_nothing_is_rejected_but_empty_texts(spark):
    rows = [(1, "der die das", None, None, 1), (2, "", None, None, 1), (3, None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.lang, r.kept) for r in language.identify(language.document_records(frame)).collect()}
    assert got == {1: (None, True), 2: (None, False), 3: (None, False)}


def test_many_declared_languages(spark):
    """Evidence is an array over the languages: many of them do not make the plan grow."""
    rng = random.Random(6)
    stems = {k: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=4)) for _ in range(12)] for k in range(80)}
    rows = [(k * 3 + j, " ".join(rng.choices(stems[k], k=40)), f"l{k:02}", f"s{k % 7}", 1) for k in range(80) for j in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    start = time.time()
    got = language.identify(language.document_records(frame)).collect()
    assert time.time() - start < 60
    assert all(r.kept and r.lang == f"l{r.doc_id // 3:02}" for r in got)
