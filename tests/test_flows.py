"""Reachability by bitmaps against plain breadth-first searches on random graphs."""

import random

import pytest

from cartolode.operators import flows
from cartolode.plans.registry import ORACLE_SQL


def plain(edges, seeds, most, stop=()):
    """(seed, node) to the smallest of the shortest paths."""
    out = {}
    for s in seeds:
        level, seen = {s: (s,)}, {s: (s,)}
        for hop in range(most):
            new = {}
            for node, path in level.items():
                if node in stop and hop:
                    continue
                for a, b in edges:
                    if a == node and b not in seen:
                        new[b] = min(new.get(b, (*path, b)), (*path, b))
            seen |= new
            level = new
        out |= {(s, n): p for n, p in seen.items()}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_reach_equals_plain_search(spark, seed):
    rnd = random.Random(seed)
    n = 40
    edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(75)] + [(3, 3)]
    seeds, stop = rnd.sample(range(n), 12), rnd.sample(range(n), 6)
    frame = lambda rows, names: spark.createDataFrame([(r,) if isinstance(r, int) else r for r in rows], names)
    e, nodes = frame(edges + edges[:3], "src long, dst long"), frame(range(n), "node long")
    for most in (0, 3, 12):
        way = flows.Reach(e, frame([*seeds, seeds[0]], "seed long"), most, frame(stop, "node long"))
        want = plain(edges, seeds, most, set(stop))
        got = {(r["seed"], r["node"]): (r["distance"], r["path"]) for r in way.paths(way.pairs(nodes)).collect()}
        assert got == {k: (len(p) - 1, ">".join(map(str, p))) for k, p in want.items()}
    near = {r["node"]: (r["distance"], r["seed"]) for r in flows.nearest(e, frame(seeds, "seed long"), 5).collect()}
    want = {}
    for (s, node), p in plain(edges, seeds, 5).items():
        want[node] = min(want.get(node, (99, 99)), (len(p) - 1, s))
    assert near == want


@pytest.mark.parametrize("seed", range(2))
def test_flows_equal_plain_search_at_every_depth(spark, seed):  # F9 F10
    rnd = random.Random(20 + seed)
    n = 45
    edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(95)] + [(3, 3)]
    sources, sinks = rnd.sample(range(n), 12), rnd.sample(range(n), 7)
    sinks.append(sources[0])
    frame = lambda rows, names: spark.createDataFrame([(r,) if isinstance(r, int) else r for r in rows], names)
    for most in (0, 1, 5, 12):
        got = flows.taint_flows(frame([*edges, edges[0], (None, 1), (2, None)], "src long, dst long"), frame([*sources, (None,), sources[1]], "node long"), frame([*sinks, (None,), sinks[0]], "node long"), most)
        want = {k: p for k, p in plain(edges, sources, most, set(sinks)).items() if k[1] in sinks}
        assert sorted(map(tuple, got.collect())) == sorted((*k, len(p) - 1, ">".join(map(str, p))) for k, p in want.items())


def test_long_flows_are_told_once_not_hop_by_hop(spark, monkeypatch):  # F9 F10
    """Forty sources and forty sinks over a chain of ten: what is written does not hold a row for every pair and hop."""
    written, write = [], flows.save

    def save(df, name):
        df = write(df, name)
        written.append(df.count())
        return df

    monkeypatch.setattr(flows, "save", save)
    calls = [(k, 100) for k in range(40)] + [(k, k + 1) for k in range(100, 110)] + [(110, 200 + k) for k in range(40)]
    ends = [spark.range(a, a + 40).selectExpr("id as node") for a in (0, 200)]
    got = flows.taint_flows(spark.createDataFrame(calls, "src long, dst long"), *ends).collect()
    assert len(got) == 1600 and {r["depth"] for r in got} == {12}
    assert sum(written) < 1600


def test_risks_equal_plain_search_and_make_the_calls_once(spark, monkeypatch):  # F10
    rnd = random.Random(40)
    n, kinds, write = 45, [], flows.save
    edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(95)] + [(3, 3), (None, 1), (2, None)]
    sources, sinks = rnd.sample(range(n), 12), rnd.sample(range(n), 7)
    sinks.append(sources[0])
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    monkeypatch.setattr(flows, "save", lambda df, name: kinds.extend(t for _, t in df.dtypes) or write(df, name))
    nodes = [spark.createDataFrame([(x,) for x in ends], "node long") for ends in (sources, sinks)]
    for most in (0, 5, 12):
        calls = spark.createDataFrame(edges, "src long, dst long").mapInArrow(counted, "src long, dst long")
        before = read.value
        got = flows.dataflow_risks(calls, *nodes, most).collect()
        assert read.value - before == len(edges)
        want = {(s, t): len(p) - 1 for (s, t), p in plain(edges, sources, most, set(sinks)).items() if t in sinks and None not in p}
        told = sorted((r["source"], r["sink"], r["kind"], r["confidence"]) for r in got if r["kind"] != "bridge")
        assert told == sorted((*k, "propagated" if d else "direct", "high" if d <= 1 else "medium") for k, d in want.items())
        bridges = {tuple(r)[:3] for r in flows.dataflow_bridges(calls, *nodes).collect()}
        assert {(r["bridge"], r["source"], r["sink"]) for r in got if r["kind"] == "bridge"} == bridges
    assert not any(k.startswith("array") for k in kinds)


def test_many_seeds_share_words(spark):
    e = spark.range(300).selectExpr("id as src", "300 as dst").union(spark.sql("select 300L as src, 301 as dst"))
    way = flows.Reach(e, spark.range(300).selectExpr("id as seed"), 5)
    assert way.hops[1].count() <= 20 and way.pairs(spark.sql("select 301L as node")).count() == 300
    assert flows.Reach(e, spark.range(0).selectExpr("id as seed"), 5).pairs(e.selectExpr("dst as node")).count() == 0


def test_importers_of_many_files_of_one_name_form_few_pairs(spark):
    """Each of 4,000 importers asks for a name that 4,000 files of two repositories have; the report joins them with its first targets only."""
    files = spark.range(4000).selectExpr("concat('r', id % 2) as repo", "concat('/x', if(id % 2 = 0, '.js', '.ts')) as path")
    imports = spark.range(4000).selectExpr("concat('r', id % 3) as repo", "lpad(id, 5, '0') as path", "'/x.mjs' as resolved")
    got = [tuple(r) for r in flows.cross_repo_importers(imports.union(imports), files, 3).collect()]
    assert got == [("r0", "/x.js", "r1", f"{p:05}", True) for p in (1, 4, 7)]
    plan = flows.cross_repo_importers(imports, files.where("repo = 'r0'"), 5000)
    assert plan.count() == 2666 and not plan.where("truncated").count()
    alone = flows.cross_repo_importers(imports.where("repo = 'r1'"), files, 3)
    assert {r["owner"] for r in alone.collect()} == {"r0"}


def test_reexports_go_round_cycles_and_read_the_whole_graph(spark):
    rnd = random.Random(5)
    stars = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(70)] + [(1, 1), (None, 2)]
    exports = [(p, f"n{p}_{k}") for p in range(60) for k in range(2)] + [(7, None), (None, "lost")]
    want, more = set(exports), set(exports)
    while more:
        more = {(a, n) for a, b in stars for p, n in more if b is not None and p == b} - want
        want |= more
    got = flows.expand_reexports(spark.createDataFrame(exports, "path long, name string"), spark.createDataFrame(stars, "src long, dst long")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert "lineitem" in ORACLE_SQL["reexport_closure"] and "p_size" not in ORACLE_SQL["reexport_closure"]


def test_collisions_meet_in_the_middle(spark):  # F5
    """Against every pair by itself, with cycles, loops, nulls, repeats and files that no stream changes; pairs take one join and the sets of streams."""
    rnd = random.Random(11)
    n = 60
    edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(100)] + [(3, None), (None, 4)]
    work = [(rnd.randrange(n), rnd.choice("abcd")) for _ in range(70)] + [(5, None), (None, "a")]
    streams = {k: {s for p, s in work if p == k and s} for k in range(n)}
    for most in (1, 2, 4, 5):
        want = {}
        for seed in range(n):
            far, now = {seed: 0}, [seed]
            for hop in range(1, most + 1):
                now = sorted({a for a, b in edges if b in now and a is not None} - set(far)) if now else []
                far |= dict.fromkeys(now, hop)
            for node, hop in far.items():
                for s in streams[seed] - streams[node]:
                    for t in streams[node] - streams[seed]:
                        if hop >= 2:
                            key = (s, t, seed, node) if s < t else (t, s, node, seed)
                            want[key] = min(hop, want.get(key, hop))
        df = flows.collisions_transitive(spark.createDataFrame(work, "path long, stream string"), spark.createDataFrame(edges, "src long, dst long"), most)
        assert sorted(map(tuple, df.collect())) == sorted((*k, d) for k, d in want.items())
        assert df._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 3
    assert len(want) > 100
