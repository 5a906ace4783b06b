"""Facts, plugins, renames, candidates, scans and stateful streams on small rows, against plain versions."""

import datetime as dt
import itertools
import random

from pyspark.sql import functions as F

from cartolode.functions.scalar import name_similarity
from cartolode.operators import facts, planning, search, supply
from cartolode.sources import readers
from cartolode.streaming import state

PY = '''import os
from a.b import c

class Box:
    def put(self, x):
        if x and self.ok or x:
            return [y for y in x if y]
        return os.system(x)

async def run():
    for k in range(3):
        Box().put(k)
'''


def test_python_facts(spark):
    files = spark.createDataFrame([("a.py", PY), ("bad.py", "def ("), ("e.py", ""), ("n.py", None), ("x.js", "f()"), ("big.py", "x = 1\n" * 300_000)], "path string, content string")
    found = facts.extract_facts(files, "python").collect()
    assert {(r["path"], r["name"]) for r in found if r["kind"] == "export"} == {("a.py", "Box"), ("a.py", "run")}
    rows = {(r["path"], r["name"]): r for r in found if r["kind"] != "export"}
    assert set(rows) == {("a.py", "a.py"), ("a.py", "Box.put"), ("a.py", "run"), ("bad.py", "bad.py"), ("e.py", "e.py"), ("n.py", "n.py"), ("big.py", "big.py")}
    # One, the if, two operators that join conditions, the comprehension and its condition.
    assert rows["a.py", "Box.put"]["cc"] == 6 and rows["a.py", "run"]["cc"] == 2
    assert rows["a.py", "Box.put"]["callees"] == ["system"] and rows["a.py", "Box.put"]["line"] == 5
    assert not rows["bad.py", "bad.py"]["parse_ok"] and not rows["big.py", "big.py"]["parse_ok"] and rows["e.py", "e.py"]["parse_ok"]
    assert facts.extract_facts(files.limit(0), "python").count() == 0


TS = """import { a } from './a';
// function hidden() {}
export async function load<T>(id: string): Promise<T> {
  if (id && "if (x) {") { return fetchOne(id); }
  return cache.get(`${id} {`);
}
export const twice = (n: number) => double(n) || 0;
const keep = async x => { for (const y of x) save(y); };
export default class Store extends Base {
  private items: string[] = [];
  constructor(a: A) { super(a); init(); }
  static async find(q: string): Promise<void> { while (q) { this.step(q ? 1 : 2); } }
}
interface Shape { area(): number }
export { keep as kept, type Shape };
"""


def test_script_facts(spark):
    files = spark.createDataFrame([("a.ts", TS), ("bad.js", "function f() {"), ("e.js", None), ("x.py", "f()")], "path string, content string")
    found = facts.extract_facts(files, "javascript").collect()
    assert {r["name"] for r in found if r["kind"] == "export"} == {"load", "twice", "Store", "kept", "Shape", "default"}
    rows = {r["name"]: r for r in found if r["kind"] == "function"}
    assert set(rows) == {"load", "twice", "keep", "Store.constructor", "Store.find"}
    assert (rows["load"]["line"], rows["load"]["end_line"], rows["load"]["cc"], rows["load"]["callees"]) == (3, 6, 3, ["fetchOne", "get"])
    assert rows["twice"]["callees"] == ["double"] and rows["twice"]["cc"] == 2 and rows["keep"]["callees"] == ["save"] and rows["keep"]["cc"] == 2
    assert rows["Store.find"]["callees"] == ["step"] and rows["Store.find"]["cc"] == 3 and rows["Store.constructor"]["callees"] == ["init"]
    assert {r["path"]: r["parse_ok"] for r in found if r["kind"] == "file"} == {"a.ts": True, "bad.js": False, "e.js": True}


def test_imports_and_complexity(spark):
    files = spark.createDataFrame([("a.js", "import x from 'lib';\nimport './side';\nexport * from \"./b\";\n// if (a) {}\nif (a && b) { c = d ? 'if' : e; }"), ("b.js", None)], "path string, content string")
    assert {r["spec"] for r in facts.extract_imports(files, "javascript").collect()} == {"lib", "./side", "./b"}
    assert files.where("path = 'a.js'").select(facts.cyclomatic(files["content"]).alias("n")).first()["n"] == 4
    python = spark.createDataFrame([("a.py", PY)], "path string, content string")
    assert {r["spec"] for r in facts.extract_imports(python, "python").collect()} == {"os", "a.b"}


def test_user_extensions(spark):
    facts.register_language("lines", (".txt",), lambda path, text: [(path, "file", path, 1, len(text.split("\n")), 1, [], True)])
    facts.register_analyzer("long", lambda files: files.where("length(content) > 3").selectExpr("'long-file' as rule_id", "'info' as severity", "path"), "style")
    facts.register_analyzer("broken", lambda files: files.select("nothing"))
    facts.register_analyzer("late", lambda files: files.selectExpr("raise_error('late') as rule_id", "'info' as severity", "path"))
    try:
        files = spark.createDataFrame([("a.txt", "1\n2\n3"), ("b.txt", None)], "path string, content string")
        rows = {r["path"]: r for r in facts.extract_facts(files, "lines").collect()}
        assert rows["a.txt"]["end_line"] == 3 and not rows["b.txt"]["parse_ok"]
        issues, failed = facts.run_analyzers(files)
        assert [tuple(r) for r in issues.collect()] == [("plugin:long:long-file", "info", "style", "a.txt")] and failed == ["broken", "late"]
    finally:
        facts.LANGUAGES.pop("lines"), facts.ANALYZERS.clear()


def likeness(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    shared = lambda x, y: len(list(itertools.takewhile(lambda p: p[0] == p[1], zip(x, y))))
    longest = max(len(a), len(b))
    return max(1 - row[-1] / longest, max(shared(a, b), shared(a[::-1], b[::-1])) / longest)


def test_renames_are_those_of_the_greedy_way(spark):
    old, new = ["fetch", "load", "loadAll", "parse", "zzz"], ["fetchUser", "loads", "loadAny", "parser", "qqqq"]
    left = sorted((-likeness(a, b), a, b) for a in old for b in new if likeness(a, b) >= 0.5)
    want, used = set(), set()
    for _, a, b in left:
        if ("o", a) not in used and ("n", b) not in used:
            want.add((a, b)), used.update({("o", a), ("n", b)})
    side = lambda names: spark.createDataFrame([("f", n) for n in names], "path string, name string")
    assert {(r["old"], r["new"]) for r in facts.match_renames(side(old), side(new)).collect()} == want
    assert facts.match_renames(side(old).limit(0), side(new)).count() == 0


def test_candidates(spark):
    plans = spark.createDataFrame([(1, "Change userStore in src/user.ts"), (2, None)], "plan_id int, text string")
    files = spark.createDataFrame([("src/user.ts", 3, True), ("lib/store.ts", 30, False), ("z.py", 1, True)], "path string, fan long, at_risk boolean")
    got = {r["path"]: r["score"] for r in planning.rank_candidates(plans, files).collect()}
    assert got == {"src/user.ts": 80 + 24 + 8 + 3, "lib/store.ts": 60 + 12 + 10}


def test_mentions_of_paths(spark):
    files = spark.createDataFrame([("src/a.ts",), ("src/ab.ts",), ("a[1].ts",)], "path string")
    issues = spark.createDataFrame([("r1", "see src/a.ts."), ("r2", "xsrc/a.ts src/ab.tsx"), ("r3", "(a[1].ts)"), ("r4", None), ("r5", "x." * 5000)], "rule_id string, text string")
    got = supply.issues_by_file(issues, files, spark.createDataFrame([("src/ab.ts", "r9"), ("gone", "r9")], "path string, rule_id string"))
    assert {tuple(r) for r in got.collect()} == {("src/a.ts", "r1"), ("a[1].ts", "r3"), ("src/ab.ts", "r9")}


def test_active_claims(spark):
    at = lambda k: dt.datetime(2024, 1, 1, k)
    rows = [(1, "a", "src", at(0), at(2)), (2, "b", "src/x.ts", at(1), None), (3, "a", "src/x.ts", at(3), None), (4, "b", "lib", at(3), None), (5, "c", "src", at(4), None)]
    claims = spark.createDataFrame(rows, "id int, agent string, target string, claimed_at timestamp, expires_at timestamp")
    assert {r["id"] for r in state.claims_active(claims, "2024-01-01 03:00:00", claims.where("id = 4")).collect()} == {2, 3}


def stream(spark, path, df):
    df.write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def drain(query):
    query = query.trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None


def test_watch_is_its_batch_twin(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = lambda k: dt.datetime(2024, 1, k)
    rows = [("k", at(1), ["deps:a", "cycles:1"]), ("k", at(2), ["deps:a", "deps:b"]), ("k", at(3), ["deps:a", "deps:b"]), ("m", at(1), [])]
    shots = spark.createDataFrame(rows, "key string, at timestamp, members array<string>")
    drain(state.watch_deltas(stream(spark, str(tmp_path / "in"), shots)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")))
    got = {tuple(r) for r in spark.read.schema(state.DELTAS).parquet(str(tmp_path / "out")).collect()}
    assert got == {tuple(r) for r in state.snapshot_deltas(shots).select("key", "at", "dimension", "added", "removed").collect()} and len(got) == 4


def test_events(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"at": "2024-01-01T00:00:00Z", "kind": "touch", "data": {"file": "a"}}\n{broken\n{"kind": "x"}\n')
    rows = readers.read_events(spark, str(tmp_path)).collect()
    assert [(r["kind"], r["data"]) for r in rows] == [("touch", {"file": "a"})]
    assert readers.read_events(spark, str(tmp_path), streaming=True).isStreaming


def test_vectors_in_blocks(spark, monkeypatch):
    vectors = spark.createDataFrame([(k, [float(k % 7), float(k % 5)]) for k in range(40)], "vec_id int, embedding array<float>")
    want = {tuple(r) for r in search.vector_topk(vectors, vectors).collect()}
    monkeypatch.setattr(search, "QUERY_ROWS", 9)
    assert {tuple(r) for r in search.vector_topk(vectors, vectors).collect()} == want and len(want) == 200


def test_guard_as_a_stream(spark, tmp_path):
    changed = spark.createDataFrame([(0, "src/a"), (0, "src/no/b"), (0, "x"), (1, "x")], "contract_id int, path string")
    contract = spark.createDataFrame([(0, "src", "allowed"), (0, "src/no", "forbidden")], "contract_id int, prefix string, kind string")
    drain(state.guard_stream(stream(spark, str(tmp_path / "in"), changed), contract).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(0, "src/a", "allowed"), (0, "src/no/b", "forbidden"), (0, "x", "outside"), (1, "x", "allowed")} == {tuple(r) for r in state.guard_stream(changed, contract).collect()}


def test_cost_deltas(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("read", 1, 3, 30), ("read", 2, 5, 60), ("read", 3, 4, 48), ("read", 4, 6, 90), ("read", 6, 2, 10), ("find", 1, 1, 7), ("find", 2, 1, 7), ("find", 5, 3, 9)]
    ticks = spark.createDataFrame(rows, "tool string, tick long, calls long, tokens long")
    drain(state.watch_costs(stream(spark, str(tmp_path / "in"), ticks)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")))
    got = {tuple(r) for r in spark.read.schema(state.COST_DELTAS).parquet(str(tmp_path / "out")).collect()}
    assert got == {tuple(r) for r in state.cost_deltas(ticks).collect()}
    assert got == {("read", 1, 3, 30, 3, 30), ("read", 2, 2, 24, 5, 60), ("read", 4, 2, 30, 6, 90), ("read", 6, 2, 10, 2, 10), ("find", 1, 1, 7, 1, 7), ("find", 5, 3, 9, 3, 9)}


def test_calls_of_a_common_name_are_neither_shuffled_nor_counted(spark):
    """What is twice among the inputs is one edge, without a distinct over the pairs of calls; a report's metrics count one edge more than it shows."""
    functions = spark.range(6).selectExpr("'a' as path", "concat('a.f', id % 2) as name", "id as line")
    functions, named = functions.union(functions), spark.sql("select 'a' as path, 'p' as name")
    calls = functions.selectExpr("path", "name", "line", "'f1' as callee")
    edges = facts.semantic_edges(functions, named.union(named), named, spark.sql("select 'a' as src, 'b' as dst"), calls)
    assert edges._jdf.queryExecution().optimizedPlan().toString().startswith("Union")
    rows = [tuple(r) for r in edges.collect()]
    assert len(rows) == len(set(rows)) == 6 + 1 + 1 + 1 + 6 * 3 - 3
    nodes = facts.semantic_nodes(named.select("path"), functions, named, named)
    for most, cut in ((5, True), (24, False)):
        metrics = facts.limited_graph(nodes.union(spark.sql("select 'file:b' as id, 'file' as kind, 'b' as label")), edges, 100, most)[2]
        assert f"GlobalLimit {most + 1}" in metrics._jdf.queryExecution().optimizedPlan().toString()
        assert [tuple(r) for r in metrics.collect()] == [(2, 6, 1, 1, min(most, 24), cut)]


def test_calls_resolve_once_without_a_distinct_over_their_pairs(spark):
    """Pairs of callers and functions of a common name are many; only a function of two names or a caller of two files can repeat one."""
    calls = spark.sql("select * from values (1, 'a', 'f1'), (1, 'a', 'f1'), (2, 'a', 'f2'), (3, 'b', 'f2') as t(caller, file, callee)")
    functions = spark.sql("select * from values (10, 'a', 'f1'), (11, 'a', 'f1'), (11, 'a', 'f1'), (12, 'b', 'f2') as t(fn, file, bare)")
    imports = spark.sql("select 'a' as src, 'b' as dst")
    got = facts.resolve_calls(calls, functions, imports)
    assert sorted(map(tuple, got.collect())) == [(1, 10), (1, 11), (2, 12), (3, 12)]
    assert got._jdf.queryExecution().optimizedPlan().toString().startswith("Project")
    named = functions.union(spark.sql("select 10, 'a', 'g1'"))
    more = calls.union(spark.sql("select 1, 'a', 'g1'")).union(spark.sql("select 2, 'b', 'f2'"))
    assert sorted(map(tuple, facts.resolve_calls(more, named, imports).collect())) == [(1, 10), (1, 11), (2, 12), (3, 12)]


def test_pairs_are_told_in_blocks_that_columns_repeat(spark, monkeypatch, tmp_path):  # F3 F4
    """Whatever the tiles; and a file of a common name's pairs takes less than half a byte a pair."""
    left = spark.range(700).selectExpr("concat('k', id % 3) as k", "id as a").union(spark.sql("select 'x', 1L union all select null, 2L"))
    right = spark.range(400).selectExpr("concat('k', id % 4) as k", "concat('to-', id) as b").union(spark.sql("select null, 'n'"))
    want = sorted(map(tuple, left.join(right, "k").select("k", "a", "b").collect()))
    for block, side in ((256, 4096), (4, 16)):
        monkeypatch.setattr(facts, "BLOCK", block, raising=False)
        monkeypatch.setattr(facts, "SIDE", side, raising=False)
        assert sorted(map(tuple, facts.every_pair(left, right, ["k"], "a", "b").collect())) == want
    monkeypatch.undo()
    functions = spark.range(1500).selectExpr("'a' as path", "'a.f' as name", "id as line")
    facts.semantic_edges(functions, functions.limit(0), functions.limit(0), spark.sql("select 'a' as src, 'b' as dst"), functions.selectExpr("*", "'f' as callee")).write.parquet(str(tmp_path / "e"))
    assert sum(f.stat().st_size for f in (tmp_path / "e").glob("*.parquet")) < 1500 * 1499 / 2


def test_renames_are_taken_in_order_without_a_round_a_pair(spark):
    """Names that are all as alike are matched by name; the same as taking the sorted pairs one by one."""
    names = lambda rows: spark.createDataFrame(rows, "path string, name string")
    olds, news = [("p", f"file{chr(300 + k)}") for k in range(60)], [("p", f"file{chr(500 + k)}") for k in range(50)]
    spark.sparkContext.setJobGroup("renames", "renames")
    got = {tuple(r) for r in facts.match_renames(names(olds), names(news)).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("renames"))
    spark.sparkContext.setJobGroup("", "")
    assert got == {("p", o[1], n[1]) for o, n in zip(olds, news)} and jobs < 60
    rnd = random.Random(3)
    sides = [[(rnd.choice("pq"), "".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 9)))) for _ in range(40)] for _ in range(2)]
    pairs = names(sides[0]).selectExpr("path", "name as old").distinct().join(names(sides[1]).selectExpr("path", "name as new").distinct(), "path")
    scored = pairs.withColumn("score", name_similarity(F.col("old"), F.col("new"))).where("score >= 0.5").collect()
    want = set()
    for r in sorted(scored, key=lambda r: (r["path"], -r["score"], r["old"], r["new"])):
        if not any(w[0] == r["path"] and (w[1] == r["old"] or w[2] == r["new"]) for w in want):
            want.add((r["path"], r["old"], r["new"]))
    assert {tuple(r) for r in facts.match_renames(names(sides[0]), names(sides[1])).collect()} == want


def test_renames_meet_as_counts_of_characters(spark, monkeypatch):  # F2
    """No join forms the pairs of a group, and those that are left are what every pair of names would leave."""
    plans, write = [], facts.save

    def save(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString() if name == "pairs" else "")
        return write(df, name)

    for name, value in (("save", save), ("PIECE", 9), ("TILE", 4)):
        monkeypatch.setattr(facts, name, value, raising=False)
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcXYZ019 \u00e9\U0001f600") for _ in range(rnd.randrange(0, 12)))
    sides = [[(rnd.choice([1, 2, 3, None]), rnd.choice([word(), f"red bolt{rnd.randrange(3000)}", None])) for _ in range(150)] for _ in range(2)]
    olds, news = (spark.createDataFrame(rows, "path int, name string") for rows in sides)
    pairs = olds.selectExpr("path", "name as old").distinct().join(news.selectExpr("path", "name as new").distinct(), "path").where("old is not null and new is not null")
    want, used = set(), set()
    for r in sorted(pairs.withColumn("score", name_similarity(F.col("old"), F.col("new"))).where("score >= 0.5").collect(), key=lambda r: (r["path"], -r["score"], r["old"].encode(), r["new"].encode())):
        if not used & {(r["path"], 0, r["old"]), (r["path"], 1, r["new"])}:
            used |= {(r["path"], 0, r["old"]), (r["path"], 1, r["new"])}
            want.add((r["path"], r["old"], r["new"]))
    assert {tuple(r) for r in facts.match_renames(olds, news).collect()} == want and len(want) > 30
    assert not any("Join" in line and "levenshtein" in line for plan in plans for line in plan.split("\n"))


def test_nearest_vectors_of_tiles_are_those_of_all(spark, monkeypatch):
    """Copies, rounded ties, other lengths, nulls and what is not finite, against every pair scored by itself."""
    rnd = random.Random(9)
    rows = [(k, [round(rnd.uniform(-1, 1), rnd.choice((1, 6))) for _ in range(4)]) for k in range(60)]
    rows += [(100 + k, rows[k % 7][1]) for k in range(30)] + [(200, None), (201, [1.0]), (202, [None, 1.0, 1.0, 1.0]), (203, [1e9] * 4), (None, [1.0] * 4)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(search, "TILE_ROWS", 20)
    monkeypatch.setattr(search, "QUERY_ROWS", 9)
    df = search.vector_topk(vectors, vectors.where("vec_id % 3 = 0 or vec_id >= 200"))
    assert "FlatMapCoGroupsInPandas" in df._jdf.queryExecution().optimizedPlan().toString()
    pairs = search._scored(vectors, vectors.where("vec_id % 3 = 0 or vec_id >= 200").selectExpr("vec_id as query_id", "embedding as q")).collect()
    want = {}
    for r in sorted(pairs, key=lambda r: (r["query_id"], r["score"] is None, -(r["score"] or 0), r["vec_id"])):
        want.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == {k: v[:5] for k, v in want.items()}
