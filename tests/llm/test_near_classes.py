"""Classes of near duplicates against brute force over all pairs that agree in a band."""

import random
from itertools import combinations

import pyarrow as pa
import pytest

pytest.importorskip("panelcast.llm")
from panelcast.llm import arrays, fingerprints, shingles


@pytest.mark.parametrize("part", [3, 4096])
def test_near_ids_are_the_classes_of_all_links_in_bands(spark, monkeypatch, part):
    monkeypatch.setattr(fingerprints, "BAND_PART", part)
    rng = random.Random(8)
    texts = []
    for _ in range(12):  # chains of edits: some pairs of a band link, others do not
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((40, 90, 400)))]
        for _ in range(rng.randint(1, 9)):
            texts.append(" ".join(words))
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            words = words[rng.choice((0, 0, 2)) :]
    rng.shuffle(texts)
    texts += [texts[0], ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sig, *_ = fingerprints.signatures(*arrays.utf8(pa.array(texts)))
    sets = [set(x.tolist()) for _, _, x in shingles.sets_of(pa.array(texts))]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    one_way = 0
    for i, j in combinations(range(len(texts)), 2):
        in_band = (sig[i].reshape(fingerprints.BANDS, -1) == sig[j].reshape(fingerprints.BANDS, -1)).all(1).any()
        both = len(sets[i] & sets[j])
        if both and in_band and 100 * both >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
            one_way += sets[i] != sets[j]
    got = {r.doc_id: r.near_id for r in fingerprints.fingerprints(frame).collect()}
    assert one_way > 10 and got == {i: find(i) if sets[i] else None for i in range(len(texts))}
