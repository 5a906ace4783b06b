"""Runs of words against a plain version that looks at every period."""

import hashlib
import random
import re
import zlib

import numpy as np

from cartolode.llm import periodic

COLUMNS = "doc_id long, text string, runs string, best long, start int, n_words long"


def plain(w):
    n, found = len(w), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def numbers(words):
    known = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


def sequences(seed, n):
    rnd = random.Random(seed)
    for _ in range(n):
        out = [rnd.randint(0, 9) for _ in range(rnd.randint(0, 30))]
        for _ in range(rnd.randint(0, 4)):
            q = rnd.choice([1, 2, 5, 7, 30, 47, 48, 60, 95, 96, 97, 150, 200])
            v = rnd.choice([1, 2, 3, 50])
            unit = [rnd.randint(0, v) for _ in range(q)] if rnd.random() < 0.7 else [0] * (q - 1) + [1]
            if rnd.random() < 0.3:  # a unit that is mostly a short run itself
                unit = ([3, 4] * q)[: q - 1] + [5]
            m = int(q * rnd.choice([1.5, 2.9, 3, 3.1, 4.5, 7])) + rnd.randint(0, 3)
            out += (unit * (m // q + 1))[:m] + [rnd.randint(0, 9) for _ in range(rnd.randint(0, 5))]
        yield out


def test_runs_equal_those_of_every_period():
    cases = [*sequences(1, 250), [], [1], [1] * 23, [1] * 24, [1, 2] * 300, list(range(2000)), [1, 1, 2] * 8, [7] * 500 + [8] + [7] * 500]
    rnd = random.Random(4)
    for v in (1, 2):
        cases += [[rnd.randint(0, v) for _ in range(600)] for _ in range(4)]
    a, b = [0], [0, 1]
    while len(b) < 900:
        a, b = b, b + a
    cases += [b, [x for y in range(40) for x in (0, 1, 0, 2, 0, 1, 0, 3 + y % 2)]]
    want = [plain(c) for c in cases]
    assert sum(any(q >= 48 for *_, q in w) for w in want) > 40
    assert periodic.runs_of([np.array(c, np.int64) for c in cases]) == want
    for c, w in zip(cases[::7], want[::7]):
        assert periodic.runs_of([np.array(c, np.int64)]) == [w]


def test_long_periods():
    rnd = random.Random(8)
    unit = [rnd.randint(0, 400) for _ in range(2500)]
    w = list(range(1000, 1100)) + unit * 3 + unit[:100] + [5000]
    assert periodic.runs_of([np.array(w, np.int64)]) == [[(100, 7600, 2500)]]


def test_operator_and_query(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") * rnd.randint(1, 2) for _ in range(rnd.randint(0, 120)))) for i in range(160)]
    rows += [(160 + i, " ".join(map(str, s))) for i, s in enumerate(sequences(5, 40))] + [(300, "spam " * 400 + "\x0bend"), (301, "x" * 40_000), (302, "é \U0001f600 " * 40)]
    rows += [(303, None), (304, ""), (305, " \t"), (None, "no " * 30), (None, None), (300, "spam " * 30), rows[4], rows[4]]
    df = spark.createDataFrame([(*r, "r", 1, 2, 3) for r in rows], COLUMNS).repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, periodic.op13_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    want = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n, h = len(w), zlib.crc32(("" if d is None else str(d)).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain(w)
        keep = [True] * n
        for s, m, q in runs:
            keep[s + q : s + m] = [False] * (m - q)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        lines = digest("".join(f"{s},{m},{q}\n" for s, m, q in runs))
        want.append((d, len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None, lines, digest(" ".join(x for x, k in zip(w, keep) if k))))
    assert got == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in want) > 30
    assert periodic.find_runs(df.limit(0)).count() == 0


def test_choices_are_the_least_of_some_window():
    rnd = random.Random(6)
    for width in (1, 2, 3, 7, 24):
        v = np.array([rnd.randint(0, 30) for _ in range(90)], np.uint64)
        want = {i for a in range(len(v) - width + 1) for i in range(a, a + width) if v[i] == v[a : a + width].min()}
        assert periodic.choices(v, width).tolist() == sorted(want)
