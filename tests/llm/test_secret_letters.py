"""Secrets of letters only are costed like any other value, and prose stays."""

import pytest

from cartolode.llm import secrets

FOUND = {
    "password: QzXwRtYpLk": "QzXwRtYpLk", "pwd=XkQzRtVbNmPw": "XkQzRtVbNmPw", "passphrase: correcthorsebatterystaple": "correcthorsebatterystaple",
    "secret is QzXwRtYpLkMv": "QzXwRtYpLkMv", "password is qxzvkwrtyp": "qxzvkwrtyp", "password is correcthorsebatterystaple": "correcthorsebatterystaple",
}
PROSE = ["password is required", "The token is missing.", "secret is something", "auth: Bearer", "token: undefined", "password=placeholder", "token is extraordinary", "secret is unfortunately lost", "pass: hellohello"]


@pytest.mark.parametrize("text", FOUND)
def test_letters_are_costed(text):
    base, added = secrets.scan(text + " x")
    assert not base and [(text + " x")[x[1] : x[2]] for x in added] == [FOUND[text]] and added[0][3] >= secrets.MIN_LOG10


@pytest.mark.parametrize("text", PROSE)
def test_prose_stays(text):
    assert secrets.scan(text) == ([], [])


def test_letters_are_redacted(spark):
    df = spark.createDataFrame(list(enumerate([*FOUND, *PROSE])), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(df).collect()}
    assert [got[k] for k in range(len(FOUND))] == [t.replace(v, "<secret>") for t, v in FOUND.items()]
    assert [got[len(FOUND) + k] for k in range(len(PROSE))] == PROSE


def test_secrets_that_many_documents_hold_are_no_words(spark):
    rows = [(k, f"note {k}: pwd=QzXwRtYpLkMv end") for k in range(5)] + [(10 + k, "token: 'BvQwLkZrTpXm' and secret is QzXwRtYpLkMv") for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    words = secrets.learn_words(df)
    assert "note" in words.rank and not {"qzxwrtyplkmv", "bvqwlkzrtpxm"} & set(words.rank)
    assert all("QzXw" not in r["text"] and "BvQw" not in r["text"] for r in secrets.redact_secrets(df).collect())
    assert {r["n_guess"] for r in secrets.scan_secrets(df).collect() if r["doc_id"] < 10} == {1}
