"""Expectation-maximisation on labels drawn with known rates, and planted personal data among look-alikes."""

import random
from collections import Counter

import pytest

from cartolode.llm import pii
from tests.llm.test_operators import WORDS


def test_known_rates_are_recovered():
    rnd, rates = random.Random(1), [(0.9, 0.1), (0.8, 0.25), (0.7, 0.05), (0.6, 0.3), (0.95, 0.4)]
    shares, speaks, counts, truth = {"ssn": 0.3, "iban": 0.6}, [1.0, 0.5, 0.8, 1.0, 0.7], Counter(), Counter()
    for kind, share in shares.items():
        for _ in range(15_000):
            real = rnd.random() < share
            votes = tuple(-1 if rnd.random() > say else int(rnd.random() < (hit if real else alarm)) for (hit, alarm), say in zip(rates, speaks))
            counts[kind, votes] += 1
            truth[kind, votes] += real
    post, got, prior = pii.estimate([(k, v, n) for (k, v), n in sorted(counts.items())])
    for kind, share in shares.items():
        assert prior[kind] == pytest.approx(share, abs=0.05)
        for j, want in enumerate(rates):
            assert got[j, kind] == pytest.approx(want, abs=0.07)
    wrong = sum(abs(post[x] - truth[x] / n) * n for x, n in counts.items()) / sum(counts.values())
    assert wrong < 0.06


def test_rates_differ_by_kind():
    """A labeler that is right on one kind and guesses on the other."""
    rnd, counts = random.Random(2), Counter()
    for kind, first in (("ssn", (0.95, 0.05)), ("iban", (0.5, 0.5))):
        for _ in range(8000):
            real = rnd.random() < 0.5
            pick = lambda rate: int(rnd.random() < rate[0 if real else 1])  # noqa: B023, E731
            counts[kind, (pick(first), pick((0.85, 0.15)), pick((0.8, 0.2)))] += 1
    _, got, _ = pii.estimate([(k, v, n) for (k, v), n in sorted(counts.items())])
    assert got[0, "ssn"][0] - got[0, "ssn"][1] > 0.75 and abs(got[0, "iban"][0] - got[0, "iban"][1]) < 0.2


REAL = {
    "phone_local": "call 389-555-{k:04d} today", "ssn": "social security 412-55-{k:04d} on file", "iban": "bank account DE44 5001 0517 5407 32{k:02d} 31 here",
    "person": "name Anna Kellerman of", "email_like": "mail to jane{k} [at] example [dot] com please",
}
FALSE = ["version 000-00-0000/", "order 112-334-5566x", "see Die Wasser and", "section 900-12-0000=", "The House of", "invoice AB12 3456 7890 1234x"]


def test_planted_spans_are_told_from_look_alikes(spark):
    rnd, rows, want = random.Random(3), [], {}
    for k in range(400):
        words = [rnd.choice(WORDS["en"]) for _ in range(30)]
        kind = sorted(REAL)[k % 5]
        text = REAL[kind].format(k=k % 100) if k % 2 else FALSE[k // 2 % len(FALSE)]
        words[rnd.randrange(30)] = text
        rows.append((k, " ".join(words)))
        want[k] = kind if k % 2 else None
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = Counter((want[k], want[k] in {s.split(":")[0] for s in got[k].split(",")}) for k in got if want[k])
    wrong = sum(bool(got[k]) for k in got if not want[k])
    assert sum(n for (_, ok), n in caught.items() if ok) / 200 >= 0.9, caught
    assert wrong / 200 <= 0.1
    texts = dict(rows)
    for k, spans in got.items():
        cuts = sorted((int(s.split(":")[1]), int(s.split(":")[2])) for s in spans.split(",") if s)
        assert all(a[1] <= b[0] for a, b in zip(cuts, cuts[1:])) and all(e <= len(texts[k]) for _, e in cuts)
