"""Hard negatives against a plain version, and against the SQL."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolode.llm import negatives

SF = "/root/testdata/sf0.001"
COLUMNS = "vec_id long, label int, embedding array<double>, cell int, part int, score long, w int"


def plain(rows, every):
    rows = [(i, y, [math.floor(256 * c) for c in v]) for i, y, v in rows if y is not None and v is not None and all(c is not None and math.isfinite(c) and abs(256 * c) < 2**63 for c in v)]
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    out = []
    for n, (i, y, v) in enumerate(rows):
        if i is None or i % every:
            continue
        scored = [(clip(sum(a * b for a, b in zip(v, u))), j, z == y) for m, (j, z, u) in enumerate(rows) if m != n and len(u) == len(v)]
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        for p, j, _ in [s for s in scored if s[2]][:5]:
            fits = [s for s in scored if not s[2] and 30 * p <= 100 * s[0] <= 90 * p][:10]
            out += [(i, j, r, k, p, s) for r, (s, k, _) in enumerate(fits, 1)]
    return sorted(out, key=repr)


def vectors(seed):
    rnd, gen = random.Random(seed), np.random.default_rng(seed)
    centre = gen.normal(size=(12, 8))
    rows = []
    for i in range(900):
        v = centre[rnd.randrange(12)] + gen.normal(size=8) * rnd.choice([0.05, 0.4, 1])
        rows.append((i, rnd.randrange(4), [float(np.float32(x)) for x in v * rnd.choice([1, 1, 3])]))
    rows += [(1000 + i, i % 2, rows[0][2]) for i in range(200)] + [rows[50], rows[50], (50, 3, rows[51][2]), (None, 1, rows[50][2]), (None, 2, rows[0][2]), (None, 2, rows[0][2])]
    rows += [(2000, None, rows[0][2]), (2050, 1, None), (2100, 1, [1.0, None] * 4), (2150, 1, [math.nan] * 8), (2200, 1, [math.inf] * 8), (2250, 1, [1e300] * 8)]
    rows += [(3000 + 10 * i, i % 2, []) for i in range(4)] + [(3100 + 10 * i, i % 3, [0.5 * i, 1.0, -1.0]) for i in range(9)] + [(3300 + 10 * i, i % 3, [0.0] * 3) for i in range(3)]
    rows += [(4000 + 10 * i, i % 2, [1e6 * (i + 1), 3e16 / (i + 1)]) for i in range(12)] + [(5000 + 50 * i, 0, [float(i)]) for i in range(2)] + [(6000 + 50 * i, i, [1.0] * 5) for i in range(3)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("cell, tree, leaf, block", [(32768, 16384, 256, 512), (60, 40, 4, 3), (100, 1000, 1, 7)])
def test_negatives_equal_the_plain_version(spark, monkeypatch, cell, tree, leaf, block):
    for name, value in (("CELL", cell), ("TREE", tree), ("LEAF", leaf), ("BLOCK", block)):
        monkeypatch.setattr(negatives, name, value)
    rows = vectors(cell)
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], COLUMNS).repartition(3)
    got = negatives.mine_negatives(df, F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows, 50)


def test_bounds_hold_and_nodes_cover_all_rows(monkeypatch):
    monkeypatch.setattr(negatives, "LEAF", 8)
    gen = np.random.default_rng(2)
    x = np.floor(gen.normal(size=(700, 6)) * 80 + gen.integers(0, 3, (700, 1)) * 60)
    x[100:200] = x[7]
    tree = negatives.cover_tree(x, np.arange(700))
    below = {}
    for node in range(len(tree["parent"]) - 1, -1, -1):
        rows = set(tree["order"][tree["begin"][node] : tree["end"][node]].tolist()) if tree["begin"][node] >= 0 else below[node]
        below[node] = rows
        if node:
            below.setdefault(int(tree["parent"][node]), set()).update(rows)
    assert below[0] == set(range(700))
    for q in (x[3], -x[9], x[0] * 0, np.floor(gen.normal(size=6) * 100)):
        low, high = negatives.bounds(x[tree["center"]] @ q, float(np.linalg.norm(q)), float(tree["norm"][0]), tree["plain"], tree["wide"])
        for node, rows in below.items():
            s = x[sorted(rows)] @ q
            assert low[node] <= s.min() and s.max() <= high[node] and tree["low"][node] == min(rows)


def test_best_first_descent_leaves_out_most_of_clustered_rows(monkeypatch):
    gen = np.random.default_rng(3)
    x = np.floor((gen.normal(size=(40, 1, 16)) * 100 + gen.normal(size=(40, 100, 16)) * 4).reshape(-1, 16))
    monkeypatch.setattr(negatives, "LEAF", 50)
    tree = negatives.cover_tree(x, np.arange(len(x)))
    order = tree["order"]
    seen = []
    monkeypatch.setattr(negatives, "inner", lambda q, rows, exact, f=negatives.inner: (seen.append(len(rows)), f(q, rows, exact))[1])
    children = [[] for _ in tree["parent"]]
    for node, up in enumerate(tree["parent"].tolist()):
        if up >= 0:
            children[up].append(node)
    tree |= {"key": order, "rid": order, "label": np.zeros(len(x), np.int64), "center": np.argsort(order)[tree["center"]]}
    x = x[order]
    q = x[5]
    low, high = negatives.bounds(x[tree["center"]] @ q, float(np.linalg.norm(q)), float(tree["norm"][0]), tree["plain"], tree["wide"])
    found = negatives.descend(tree, children, 0, int(order[5]), True, 5, [(0, -negatives.TOP, negatives.TOP)], low, high, q, x, True)
    want = sorted((-int(s), int(k)) for s, k in zip(x @ q, order) if k != order[5])[:5]
    assert [(s, k) for _, s, k, _ in found] == want and sum(seen) < len(x) / 4


def test_empty_table(spark):
    assert negatives.mine_negatives(spark.createDataFrame([], COLUMNS), F.lit(True)).count() == 0


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    df = negatives.op11_hard_negatives(spark, SF)
    want = con.execute(negatives.OP11_SQL)
    names = [c[0] for c in want.description]
    want = sorted(want.fetchall())
    assert sorted(map(tuple, df.select(names).collect())) == want and want
