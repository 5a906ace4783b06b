"""The language model against a plain one, with counts held in tasks and looked up by shuffle."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolode.llm import lm
from tests.llm.test_operators import documents, word_list


def part_of(doc_id):
    left = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7
    return {2: None, 3: lm.HELD}.get(left, lm.FIT)


def plain(rows, weights):
    """(doc_id, tokens, known, N, base, score) of each row by dictionaries."""
    words = lambda t: [w.encode().lower() for w in word_list(t)]
    every, fit, context, pairs = Counter(), Counter(), Counter(), Counter()
    for d, t, *_ in rows:
        if (part := part_of(d)) is not None:
            line = [*words(t), None]
            every.update(line)
            if part == lm.FIT:
                fit.update(line)
                context.update([0, *line[:-1]])
                pairs.update(zip([0, *line[:-1]], line))
    n, v, fitted = sum(every.values()), len(every), max(sum(fit.values()), 1)
    out = []
    for d, t, *_ in rows:
        line, score = [*words(t), None], 0.0
        for a, b in zip([0, *line[:-1]], line):
            w = weights[context[a].bit_length()]
            score += math.log10(w[0] * pairs[a, b] / max(context[a], 1) + w[1] * fit[b] / fitted + w[2] / (v + 1))
        base = sum(math.log10((every[w] + 1) / (n + v + 1)) for w in line)
        out.append((d, len(line), sum(every[w] > 0 for w in line), n, round(base, 4), round(score, 4)))
    return Counter(out)


def scored(df):
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7
    rows, model = lm.fit_and_score(df, F.when(crc == 3, lm.HELD).when(crc != 2, lm.FIT))
    return [(*tuple(r)[:4], round(r["base_score"], 4), round(r["score"], 4)) for r in rows.collect()], model


@pytest.mark.parametrize("words, pairs", [(1 << 18, 1 << 20), (40, 60), (5, 3), (0, 0)])
def test_language_model(spark, words, pairs, monkeypatch):
    monkeypatch.setattr(lm, "WORDS", words)
    monkeypatch.setattr(lm, "PAIRS", pairs)
    monkeypatch.setattr(lm, "SAMPLE", 2)
    monkeypatch.setattr(lm, "PIECE", 700)
    df, rows = documents(spark, 200)
    got, model = scored(df)
    assert Counter(got) == plain(rows, model.weights)
    held = [r for r in got if part_of(r[0]) is None and r[1] > 5]
    assert sum(r[5] for r in held) / len(held) > sum(r[4] for r in held) / len(held)


def test_nothing_to_learn_from(spark):
    df, _ = documents(spark, 20)
    assert lm.score_texts(df.limit(0), F.lit(lm.FIT)).count() == 0
    assert {round(r["base_score"], 9) for r in lm.score_texts(df, F.lit(None)).collect()} == {0.0}


def test_held_out_weights_follow_the_data():
    cells = [(10, 0.5, 0.001, 400), (3, 0.0, 0.01, 400), (3, 0.2, 0.001, 4), (0, 0.0, 0.01, 100)]
    weights = lm.learn_weights(*map(np.array, zip(*cells)), 1e-6)
    assert weights[10, 0] > 0.99 and weights[3, 1] > 0.9 and weights[0, 0] == 0
    np.testing.assert_allclose(weights.sum(1), 1)
    assert lm.bucket(np.array([0, 1, 2, 3, 4, 1023, 1024])).tolist() == [0, 1, 2, 2, 3, 10, 11]


def test_the_bigram_beats_the_unigram_where_words_follow_each_other(spark):
    """Held-out texts of fixed phrases: the model's cost of each text is below that of the unigram estimate."""
    phrases = [" ".join(f"w{k}x{j}" for j in range(6)) for k in range(40)]
    rows = [(i, " ".join(phrases[(i * 7 + k * 3) % 40] for k in range(4))) for i in range(300)]
    got, _ = scored(spark.createDataFrame(rows, "doc_id long, text string"))
    assert all(r[5] > r[4] + 10 for r in got if part_of(r[0]) is None)


def test_long_texts_are_split_at_blanks(monkeypatch):
    text = b"Aa b\tcc  ddd\n" * 50
    assert len(set(lm.token_hashes(b"aa AA b bb ab ba \x00 a\x00 \x00a \x80").tolist())) == 11
    line, counts = lm.text_hashes([b"x y", b"", b" y", b"zz\tx"])
    x, y, z = lm.token_hashes(b"x y zz")[1:4]
    assert line.tolist() == [2, x, y, 4, 2, 4, 2, y, 4, 2, z, x, 4] and counts.tolist() == [4, 2, 3, 4]
    whole = lm.token_hashes(text)
    monkeypatch.setattr(lm, "PIECE", 7)
    assert (lm.token_hashes(text) == whole).all() and len(whole) == 202 and len(lm.token_hashes(None)) == 2


def test_sorted_keys_are_found():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        keys = np.sort(rng.integers(0, 1 << 63, n, np.uint64) << np.uint64(1))
        wanted = np.concatenate([keys, keys + np.uint64(1), rng.integers(0, 1 << 63, 50, np.uint64)])
        place = {int(k): i for i, k in enumerate(keys)}
        assert lm.Sorted(keys).find(wanted).tolist() == [place.get(int(k), -1) for k in wanted]
