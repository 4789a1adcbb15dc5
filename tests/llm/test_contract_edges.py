"""Cases at the edges of the contracts of the archives and of the license scan."""

import duckdb
import pyarrow as pa
import pytest

pytest.importorskip("panelcast.llm")
from panelcast.llm import licenses, warc
from panelcast.llm.queries import SQL


def test_pages_without_id_revisit_the_largest(spark):
    long, other = "x" * 1200, "y" * 1500
    pages = [(None, "u", long), (3, "v", long), (5, None, long), (None, "w", other), (None, "w", other), (7, "z", "short"), (8, "z", "short"), (9, None, None)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    rows = warc.read_archives(warc.write_archives(frame)).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in rows), key=str)
    want = [(None, 1200, "revisit", 5), (3, 1200, "revisit", 5), (5, 1200, "response", None), (None, 1500, "response", None), (None, 1500, "response", None)]
    want += [(7, 5, "response", None), (8, 5, "response", None), (9, 0, "response", None)]
    assert got == sorted(want, key=str)
    con = duckdb.connect()
    con.register("pages", pa.table({"page_id": pa.array([p[0] for p in pages], pa.int64()), "html": pa.array([p[2] for p in pages])}))
    twin = con.execute(SQL["op6_warc_zstandard"]).fetchall()
    digests = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str)
    assert digests == sorted(twin, key=str)


def test_revisits_name_their_response(spark):
    digest = "0" * 40
    response = warc.record(5, "http://a", b"x", digest, None).decode()
    revisit = warc.record(3, "http://b", b"x", digest, 5).decode()
    name = response.split("WARC-Record-ID: ")[1].split("\r\n")[0]
    assert f"WARC-Refers-To: {name}\r\n" in revisit and name not in revisit.split("WARC-Refers-To")[0]
    with pytest.raises(ValueError, match="another record"):
        warc.parse(revisit.replace("X-Refers-To-Page-ID: 5", "X-Refers-To-Page-ID: 6").encode(), "here")


@pytest.mark.parametrize("end", ["\u0085", "\u2028", "\u2029", "", " ", "\n", "\u00e9", "\u212a"])
def test_places_at_the_end_of_a_text(spark, end):
    texts = [f"all rights reserved{end}", f"CC BY{end}", f"x general public license{end} all rights reserved", "AK cc by"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)}))
    twin = con.execute(licenses.SQL)
    names = [c[0] for c in twin.description]
    got = sorted(tuple(r[n] for n in names) for r in licenses.scan(rows).collect())
    assert got == sorted(twin.fetchall())
    first = next(r for r in got if r[0] == 0)
    assert first[names.index("n_base")] == (1 if end in ("", " ", "\n") else 0)


def test_mixed_documents_with_clashing_columns(spark):
    from panelcast.llm import mixing

    rows = [(i, " ".join(["w"] * (5 + i % 7)), ["a", "b", None][i % 3], 1, "c", 2, "t", 0) for i in range(60)]
    rows += [(None, "x y z", "a", 1, "c", 2, "t", 0), (None, "p q r", "a", 1, "c", 2, "t", 0), (7, None, "b", 1, "c", 2, "t", 0)]
    names = "doc_id long, text string, source string, n_chars long, copies string, __size int, taken string, size int"
    frame = spark.createDataFrame(rows, names).repartition(3)
    plain = mixing.mixed_documents(frame.select("doc_id", "text", "source", "n_chars"))
    mixed = mixing.mixed_documents(frame)
    assert mixed.columns == frame.columns
    key = lambda r: (str(r.doc_id), r.text, str(r.source), r.n_chars)
    got = mixed.collect()
    assert sorted(map(key, got)) == sorted(map(key, plain.collect())) and got
    assert all((r.copies, r["__size"], r.taken, r["size"]) == ("c", 2, "t", 0) for r in got)
    taken = sum(r.taken for r in mixing.mixture(frame).collect())
    assert abs(sum(len(r.text.split()) for r in got) - taken) <= 1
