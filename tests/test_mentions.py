"""Mentions of names in texts against plain searches."""

import random

import pytest

from cartolode.operators import mentions


def plain(texts, names, boundary=None):
    def fits(t, n):
        at = t.find(n)
        while at >= 0:
            if boundary is None or (at == 0 or t[at - 1] in boundary) and (at + len(n) == len(t) or t[at + len(n)] in boundary):
                return True
            at = t.find(n, at + 1)
        return False

    return sorted({(k, n) for k, t in texts for n in names if t and n and fits(t, n)}, key=str)


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_mentions_equal_plain_searches(spark, monkeypatch, block):
    monkeypatch.setattr(mentions, "BLOCK", block)
    rnd = random.Random(block)
    word = lambda a, b: "".join(rnd.choice("ab/.é\U0001f600") for _ in range(rnd.randint(a, b)))
    names = [word(1, 6) for _ in range(60)] + ["", None, "a" * 300, "ab", "ab"]
    texts = [(k % 50, word(0, 40)) for k in range(120)] + [(60, None), (61, ""), (62, "a" * 5000), (None, "ab"), (63, "x"), (63, "x")]
    t, n = spark.createDataFrame(texts, "k long, text string"), spark.createDataFrame([(x, 1) for x in names], "name string, text int")
    assert sorted(map(tuple, mentions.mentions(t, n, "k").collect()), key=str) == plain(texts, names)
    assert sorted(map(tuple, mentions.mentions(t, n, "k", boundary="/.").collect()), key=str) == plain(texts, names, "/.")


def test_no_names_and_no_texts(spark):
    t, n = spark.createDataFrame([(1, "a")], "k long, text string"), spark.createDataFrame([("",), (None,)], "name string")
    assert mentions.mentions(t, n, "k").count() == 0 and mentions.mentions(t.limit(0), t.selectExpr("text as name"), "k").count() == 0
