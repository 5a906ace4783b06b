"""The guess cost against all segmentations, and planted values that are weak or strong."""

import math
import random

import pytest

from cartolode.llm import secrets
from cartolode.llm.secrets import KIND, REPEAT, WALK, Dictionary, guess_cost


def all_segmentations(value, words):
    """The least cost over every way to cut value into parts, each part over every kind that it fits."""
    low, each, back = value.lower(), secrets.brute_cost(value), secrets.distances(value)
    plain, keys = low.translate(secrets.LEET), low.translate(secrets.UNSHIFT)

    def part(i, j):
        costs = [each * (j - i)]
        if (word := words.word_cost(value[i:j], low[i:j], plain[i:j])) is not None and j - i > 1:
            costs.append(word)
        if secrets.DATE.fullmatch(value[i:j]):
            costs.append(secrets.date_cost(j - i))
        if j - i >= WALK and all(secrets.adjacent(keys[k], keys[k + 1]) for k in range(i, j - 1)):
            costs.append(secrets.FIRST_KEY + secrets.STEP * (j - i - 1))
        if back[i] and j - i >= REPEAT and all(value[k] == value[k - back[i]] for k in range(i, j)):
            costs.append(math.log10(back[i]) + math.log10(j - i))
        return KIND + min(costs)

    def least(i):
        return 0.0 if i == len(value) else min(part(i, j) + least(j) for j in range(i + 1, len(value) + 1))

    return least(0) - KIND


@pytest.mark.parametrize("alphabet", ["ab1", "asdfqwe12", "aA@p4sS", "0123456789", "passwordhello1!", "wert567ygv"])
def test_no_segmentation_is_cheaper(alphabet):
    rnd, words = random.Random(alphabet), Dictionary(["asd", "wert", "abba", "passw"])
    for _ in range(60):
        value = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 10)))
        assert guess_cost(value, words) == pytest.approx(all_segmentations(value, words)), value
    for value in ("asdfghello", "20240131x", "31.12.1999", "hellohello", "abcabcabca", "1qaz2wsx", "Passw0rd!!"):
        assert guess_cost(value, words) == pytest.approx(all_segmentations(value, words)), value


def test_parts_cost_what_their_kind_says():
    assert guess_cost("asdfghello") < 7 and guess_cost("1qaz2wsx") < 9 and guess_cost("Passw0rd!" * 20) < 12
    assert guess_cost("x" * 50_000) < 9 and guess_cost("qwertyuiop" * 300) < 12 and guess_cost("abcdefgh") < 6
    assert guess_cost("z" * 195 + "x9$Kq2vLm#8") > 20


WEAK = ["password1", "qwerty123", "letmein!!", "hello2019", "dragon99", "11111111", "abcabcabc", "zaq12wsx", "summer2020", "asdfasdf", "P@ssw0rd", "monkey!1"]


def test_planted_values_are_told_apart():
    rnd = random.Random(1)
    strong = ["".join(rnd.choice("bcdfghjkmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ2346789#%&*!") for _ in range(n)) for n in (8, 9, 10, 12, 16, 24) for _ in range(20)]
    found = lambda v: bool(secrets.scan(f"login pwd: {v} end")[1])
    assert not any(map(found, WEAK)) and all(map(found, strong))


def test_words_are_learned_from_all_documents(spark):
    rows = [(k, f"the xylograph and the quokka {k}") for k in range(9)] + [(9, "blatherskite"), (10, None), (11, "")]
    words = secrets.learn_words(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {"xylograph", "quokka"} <= set(words.rank) and "blatherskite" not in words.rank
    assert guess_cost("quokkaxylograph", words) < 7 < guess_cost("quokkaxylograph")
    df = spark.createDataFrame([(1, "pwd is quokkaxylograph"), (2, "pwd is quokkaxylqgraph")], "doc_id long, text string")
    assert [r["n_guess"] for r in secrets.scan_secrets(df, words=words).orderBy("doc_id").collect()] == [0, 1]
    assert set(secrets.learn_words(spark.createDataFrame([], "text string")).rank) == set(secrets.DEFAULT.rank)
