"""The language model against plain Kneser-Ney probabilities, and rejection on languages that it has not learned."""

import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from cartolode.llm import langid
from tests.llm.test_operators import WORDS


def plain(lines, order=4):
    """P(character | context) by interpolated Kneser-Ney over the lines, as a function."""
    top = Counter(line[k : k + order] for line in lines for k in range(len(line) - order + 1))
    levels = {order: top}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    total, kinds, cut = {}, {}, {}
    for k, counts in levels.items():
        total[k], kinds[k] = defaultdict(int), defaultdict(int)
        for g, n in counts.items():
            total[k][g[:-1]] += n
            kinds[k][g[:-1]] += 1
        once, twice = (sum(n == x for n in counts.values()) for x in (1, 2))
        cut[k] = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)

    def p(text, k, floor):
        if k == 0:
            return floor
        g = text[-k:]
        lower = p(text, k - 1, floor)
        if not total[k][g[:-1]]:
            return lower
        return max(levels[k][g] - cut[k], 0) * (g in levels[k]) / total[k][g[:-1]] + cut[k] * kinds[k][g[:-1]] / total[k][g[:-1]] * lower

    return p


def test_probabilities_are_those_of_kneser_ney():
    rnd = random.Random(3)
    lines = {x: ["   " + " ".join(rnd.choice(WORDS[x]) for _ in range(30)) + " " for _ in range(20)] for x in ("en", "de")}
    counts = [(x, line[k : k + 4]) for x in lines for line in lines[x] for k in range(len(line) - 3)]
    frame = pd.DataFrame(Counter(counts).items(), columns=["key", "n"])
    frame = pd.DataFrame({"lang": [k[0] for k in frame["key"]], "gram": [k[1] for k in frame["key"]], "n": frame["n"]}).sample(frac=1, random_state=1)
    model = langid.Model(frame)
    text = "   the house und wasser schqxz stone über nicht "
    got = model.log_probs(np.array([ord(c) for c in text], np.uint32))
    for k, lang in enumerate(model.langs):
        p = plain(lines[lang])
        want = [np.log(p(text[max(0, i - 3) : i + 1], 4, np.exp(model.floor))) for i in range(3, len(text))]
        np.testing.assert_allclose(got[:, k], want, rtol=1e-4)


def language(rnd, letters, n):
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7))) for _ in range(n)]


def test_texts_of_left_out_languages_are_rejected(spark):
    """Four invented languages of their own words; of each one the texts are judged by a model of the others."""
    rnd = random.Random(5)
    words = {f"x{k}": language(rnd, letters, 120) for k, letters in enumerate(("aeiouklmnp", "aeirstdlnuv", "oaeghtbmwy", "uioazjkxqs"))}
    rows = [(i, " ".join(rnd.choice(words[x]) for _ in range(rnd.randint(30, 90))), x) for i, x in enumerate(sorted(words) * 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    assert max(model.errors) < 0.05
    for left in ("x0", "x3"):
        without = langid.train(df.where(f"lang <> '{left}' and doc_id % 16 >= 4"))
        got = langid.identify(df.where(f"lang = '{left}' or doc_id % 16 < 4"), without).join(df.select("doc_id", "lang"), "doc_id").toPandas()
        foreign = got["lang"] == left
        assert got[foreign]["rejected"].mean() > 0.9 and got[~foreign]["rejected"].mean() < 0.03


def test_rows_without_ids_are_learned_from(spark):
    rnd = random.Random(6)
    some = lambda: "".join(rnd.choice("abcdefghijkl") for _ in range(6))
    rows = [(None, f"the house of stone and water {some()}", "en") for k in range(60)] + [(None, f"das haus und der stein {some()}", "de") for k in range(60)]
    df = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, lang string")
    assert langid.train(df).langs == ["de", "en"]
    got = langid.identify(df, langid.train(df)).collect()
    assert Counter(r["lang_pred"] for r in got) == {"en": 65, "de": 60}
    assert len(langid.train(df, train_chars=200).gram[-1].hash) < len(langid.train(df).gram[-1].hash)


def test_languages_of_a_few_long_texts_are_learned(spark):
    rnd = random.Random(9)
    en, de = "the house of stone and water by night".split(), "das haus und der stein bei nacht über".split()
    rows = [(k, " ".join(rnd.choice(en) for _ in range(30)), "en") for k in range(300)]
    rows += [(400 + k, " ".join(rnd.choice(de) for _ in range(8000)), "de") for k in range(2)] + [(500 + k, " ".join(rnd.choice(de) for _ in range(30)), None) for k in range(20)]
    for shift in (0, 1000, 2000):
        df = spark.createDataFrame([(k + shift, t, x) for k, t, x in rows], "doc_id long, text string, lang string")
        model = langid.train(df, train_chars=8000)
        assert model.langs == ["de", "en"]
        assert {r["lang_pred"] for r in langid.identify(df.where("lang is null"), model).collect()} == {"de"}
