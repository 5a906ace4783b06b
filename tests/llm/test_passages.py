"""Substring dedup against a plain version, and against its SQL."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from cartolode.llm import passages

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, row long, key long, marks string, h int, start int"


def plain(rows, width):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = {}
    for r, w in enumerate(words):
        for i in range(len(w) - width + 1):
            seen.setdefault(tuple(w[i : i + width]), []).append((rows[r][0], r, i))
    out = []
    for r, w in enumerate(words):
        cut, me = [False] * len(w), rows[r][0]
        for i in range(len(w) - width + 1):
            for doc, r2, j in seen[tuple(w[i : i + width])]:
                if (doc is not None and (me is None or doc < me)) or (r2 == r and j < i):
                    cut[i : i + width] = [True] * width
                    break
        kept = " ".join(x for x, c in zip(w, cut) if not c)
        out.append((rows[r][0], len(w), sum(cut), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rnd = random.Random(seed)
    text = lambda n, v: " ".join(rnd.choice(v) for _ in range(n))
    many, few = [f"w{k}é" for k in range(500)], ["a", "b"]
    line, passage = text(12, many), text(60, many)
    rows = [(i, f"{text(rnd.randint(0, 60), many)} {line} {text(rnd.randint(0, 60), many)}") for i in range(80)]
    rows += [(100 + i, f"{text(30, many)}\t{passage[:rnd.randint(200, 300)]}\n{text(20, many)}") for i in range(12)]
    rows += [(200 + i, rows[3][1]) for i in range(30)] + [(300, text(400, few)), (301, "x " * 300), (302, passage + " " + passage)]
    rows += [(303, None), (304, ""), (305, " \t\n"), (306, text(19, many)), (307, "long " * 5000 + passage), (308, "y" * 50_000)]
    rows += [(None, rows[5][1]), (None, rows[5][1]), (None, passage), (7, rows[7][1]), (7, passage), (400, rows[7][1]), (400, rows[7][1] + " " + passage)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("piece, common", [(8 << 20, 0.01), (2000, 0.01), (3000, 2.0)])
def test_repeats_equal_the_plain_version(spark, monkeypatch, piece, common):
    monkeypatch.setattr(passages, "PIECE", piece)
    monkeypatch.setattr(passages, "COMMON", common)
    rows = corpus(piece)
    df = spark.createDataFrame([(*r, 1, 2, "m", 3, 4) for r in rows], COLUMNS).repartition(4)
    for width in (20, 7):
        got = passages.remove_repeats(df, width=width).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in got), key=repr) == plain(rows, width)
        for r in got:
            assert r["n_removed"] == sum(s["end"] - s["start"] for s in r["spans"]) and all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))


def test_common_anchors_change_routing_only(spark, monkeypatch):
    rows = corpus(1)
    df = spark.createDataFrame([(*r, 1, 2, "m", 3, 4) for r in rows], COLUMNS)
    some = passages.common_anchors(df.select("doc_id", "row", "text"), 20, 10)
    assert len(some)  # the line of twelve words stands in eighty documents
    whole = sorted(map(tuple, passages.remove_repeats(df).drop("spans").collect()), key=repr)
    monkeypatch.setattr(passages, "common_anchors", lambda *_: np.zeros(0, np.uint64))
    assert sorted(map(tuple, passages.remove_repeats(df).drop("spans").collect()), key=repr) == whole


def test_rolling_hashes():
    ids = np.array([5, 7, 5, 7, 5, 9], np.uint64)
    grams = passages.Rolling(ids).grams(2)
    assert grams[0] == grams[2] and grams[1] == grams[3] and len(set(grams.tolist())) == 3
    assert len(passages.Rolling(ids[:1]).grams(2)) == 0 and len(passages.Rolling(ids[:0]).grams(1)) == 0


def test_empty_table(spark):
    assert passages.remove_repeats(spark.createDataFrame([], COLUMNS)).count() == 0


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    df = passages.op12_substring_dedup(spark, SF)
    want = con.execute(passages.OP12_SQL)
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, df.select(names).collect())) == sorted(want.fetchall())
