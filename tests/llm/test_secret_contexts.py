"""Values behind the main credential words, with signs that the base pattern does not know."""

import pytest

pytest.importorskip("panelcast.llm")
from panelcast.llm import secrets

VALUE = "x7$Kq9!mPz2w"


def found(text):
    return [text[s:e] for s, k, e in secrets.byte_spans(text.encode()) if k == 3]


@pytest.mark.parametrize("word", ["password", "passwd", "secret", "token", "api_key", "apikey", "my_token", "dbpassword", "pwd"])
@pytest.mark.parametrize("between", [": ", "=", " is ", ' = "'])
def test_sign_bearing_values(word, between):
    assert found(f"the {word}{between}{VALUE}") == [VALUE]


def test_values_the_base_pattern_does_not_see():
    assert found("token: !Qz8#Lm2$Vb6") == ["!Qz8#Lm2$Vb6"]
    assert found("password is x7Kq9mPz2wLt") == ["x7Kq9mPz2wLt"]
    for head in ("Authorization: Bearer ", "authorization=bearer ", "bearer ", "Bearer: ", "token: Bearer "):
        assert found(head + "x7Kq9mPz2wLt") == ["x7Kq9mPz2wLt"], head


def test_a_value_beyond_a_base_span_is_scored_whole(spark):
    text = "so password = abc123$Rk9!wQz#77 ends"
    assert [(text[s:e], k) for s, k, e in secrets.byte_spans(text.encode())] == [("password = abc123", 0), ("abc123$Rk9!wQz#77", 3)]
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert "$Rk9" not in (clean := secrets.redacted(frame).first().text) and clean.startswith("so ") and clean.endswith(" ends")


def test_cheap_and_covered_values_are_not_named():
    assert found("password: changeme") == [] and found("token = abcdefghij") == [] and found("secret: Xk29fhq81Lsm") == []
    assert found("password: password: x7$Kq9!mPz2w") == [VALUE]
    assert found("pwd=" * 5000) in ([], ["pwd=" * 4999])
