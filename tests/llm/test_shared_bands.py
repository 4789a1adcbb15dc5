"""The links of op5 look at bands of several sets only."""

from panelcast.llm.fingerprints import BANDS, PERMUTATIONS, band_pairs, shared_bands


def test_bands_of_one_set_are_left_out(spark):
    width = 2 * PERMUTATIONS // BANDS
    sig = lambda *parts: bytearray(b"".join(bytes([p]) * width for p in parts))
    one, two = sig(*range(1, BANDS + 1)), sig(1, *range(101, 100 + BANDS))
    alone, empty = sig(*range(201, 201 + BANDS)), sig(*([1] * BANDS))
    # set 7 twice, as equal texts have it; a set without words (0) shares no band
    rows = [(5, one), (-3, two), (7, alone), (7, alone), (0, empty)]
    shared = shared_bands(spark.createDataFrame(rows, "set_id long, sig binary"))
    assert {(r["band"], bytes(r["value"]), r["set_id"], r["a"]) for r in shared.collect()} == {(0, b"\1" * width, s, -3) for s in (5, -3)}
    assert [tuple(r) for r in band_pairs(shared).collect()] == [(-3, 5)]
