"""The encoder's bounded store of pretokens: ids stay the tokenizer's, memory stays bounded."""

import random

import pyarrow as pa
import pytest

pytest.importorskip("panelcast.llm")
from panelcast.llm import arrays, packing


@pytest.mark.parametrize("known, ids", [(3, 8), (40, 10_000), (200_000, 30)])
def test_ids_do_not_depend_on_what_is_remembered(monkeypatch, known, ids):
    monkeypatch.setattr(packing, "MOST_KNOWN", known)
    monkeypatch.setattr(packing, "MOST_IDS", ids)
    rng = random.Random(1)
    e = packing.Encoder(packing.default_tokenizer())
    stems = ["".join(rng.choices("abcdéß12 .", k=rng.randint(1, 9))) for _ in range(90)]
    for _ in range(25):
        texts = [" ".join(rng.choices(stems, k=rng.randint(0, 60))) for _ in range(4)]
        got, first = e.encode(*arrays.utf8(pa.array(texts)))
        for t, a, b in zip(texts, first[:-1], first[1:], strict=True):
            assert got[a:b].tolist() == [*e.tokenizer.encode(t, add_special_tokens=False).ids, 0]
        distinct = 4 * 61 * 6
        assert len(e.known) <= max(known, distinct) and len(e.ids) <= max(ids, 0) + 8 * distinct


def test_a_store_is_made_once(monkeypatch):
    e = packing.Encoder(packing.default_tokenizer())
    store = e.ids
    for k in range(30):
        e.encode(*arrays.utf8(pa.array([f"w{k} x{k * k} plain words"])))
    assert e.ids is store and e.n > 30
