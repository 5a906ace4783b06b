"""Readers on small files, and streams against their batch twins."""

import json
import uuid

from pyspark.sql import functions as F

from cartolode.operators import evidence
from cartolode.sources import listing, readers, sarif
from cartolode.streaming import feeds


def test_git_log(spark, tmp_path):
    (tmp_path / "log").write_text("COMMIT|a1|X@y.z|1700000000\nsrc/a.py\nsrc\\b.py\n\nCOMMIT|b2|w@y.z|1700000100\nsrc/a.py\n")
    rows = readers.read_git_log(spark, str(tmp_path / "log")).select("commit_hash", "author", F.unix_timestamp("ts"), "path").collect()
    assert sorted(map(tuple, rows)) == [("a1", "x@y.z", 1700000000, "src/a.py"), ("a1", "x@y.z", 1700000000, "src/b.py"), ("b2", "w@y.z", 1700000100, "src/a.py")]


def test_coverage(spark, tmp_path):
    (tmp_path / "lcov").write_text("TN:\nSF:src/a.ts\nDA:1,1\nLF:8\nLH:6\nend_of_record\nSF:src/b.ts\nLF:0\nLH:0\nend_of_record\n")
    assert sorted(map(tuple, readers.read_lcov(spark, str(tmp_path / "lcov")).collect())) == [("src/a.ts", 8, 6, 75.0), ("src/b.ts", 0, 0, 0.0)]
    (tmp_path / "s.json").write_text('{"total": {"lines": {"total": 9}}, "a": {"lines": {"total": 4, "covered": 1, "pct": 25}}, "b": {"lines": {"total": 4, "covered": 3}}}')
    assert sorted(map(tuple, readers.read_coverage_summary(spark, str(tmp_path / "s.json")).collect())) == [("a", 4, 1, 25.0), ("b", 4, 3, 75.0)]


def test_codeowners(spark, tmp_path):
    (tmp_path / "OWNERS").write_text("# all\n* @root\n/docs/ @writers\nsrc/**/x.py @x\nlonely\n")
    rules = readers.read_codeowners(spark, str(tmp_path / "OWNERS"))
    assert [r["owner"] for r in rules.orderBy("rule_no").collect()] == ["@root", "@writers", "@x"]
    files = spark.createDataFrame([("docs/a/b.md",), ("src/p/q/x.py",), ("main.py",)], "path string")
    owned = files.join(F.broadcast(rules), F.expr("path rlike regex")).groupBy("path").agg(F.max_by("owner", "rule_no").alias("owner"))
    assert dict(map(tuple, owned.collect())) == {"docs/a/b.md": "@writers", "src/p/q/x.py": "@x", "main.py": "@root"}


def test_ledger_and_snapshot(spark, tmp_path):
    records = spark.sql("SELECT 'run API_TOKEN=abc123 x' AS command, 0 AS exit_code, TIMESTAMP '2024-01-01 00:00:00' AS completed_at, 5L AS duration_ms")
    path = str(tmp_path / "ledger")
    readers.append_ledger(records, path)
    readers.append_ledger(records, path)
    (tmp_path / "ledger" / "bad.json").write_text('{"command": \n not json\n')
    got = readers.read_ledger(spark, path).collect()
    assert len(got) == 2 and got[0]["command"] == "run API_TOKEN=[redacted] x"
    facts = spark.createDataFrame([("r", "base", "a", 1), ("r", "head", "a", 2)], "repo string, snapshot string, path string, v int")
    readers.write_snapshot(facts, str(tmp_path / "snap"))
    assert readers.read_snapshot(spark, str(tmp_path / "snap")).where("snapshot = 'head'").first()["v"] == 2
    assert readers.read_snapshot(spark, str(tmp_path / "snap"), version=2).count() == 0
    none = readers.read_snapshot(spark, str(tmp_path / "none"), schema="repo string, v int")
    assert none.count() == 0 and none.columns == ["repo", "v"]


def stream(spark, make, tmp_path, mode):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("tool", F.col("event_type")).withColumn("tokens", F.floor("value"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    name = f"s{uuid.uuid4().hex}"
    feed = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = make(feed).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    return sorted(map(tuple, spark.table(name).collect()), key=repr), sorted(map(tuple, make(events).collect()), key=repr)


def test_sessions_stream_equals_batch(spark, tmp_path):
    streamed, batch = stream(spark, lambda e: feeds.live_sessions(e, late="60 days"), tmp_path, "complete")
    assert streamed == batch and len(batch) > 500


def test_costs_stream_equals_batch(spark, tmp_path):
    streamed, batch = stream(spark, feeds.cost_totals, tmp_path, "complete")
    assert streamed == batch and batch


def test_manifests_locks_and_requirements(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.json").write_text('{"name": "a", "dependencies": {"x": "^1.0.0"}, "scripts": {"test": "run"}}')
    (tmp_path / "m" / "bad.json").write_text("{nope")
    assert sorted(map(tuple, readers.read_manifests(spark, str(tmp_path / "m")).collect())) == [("a.json", "dependencies", "x", "^1.0.0"), ("a.json", "scripts", "test", "run")]
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "p.json").write_text('{"main": "a.js", "bin": {"x": "bin/x.js"}, "exports": {".": {"import": "./m.mjs", "n": 1}, "./y": "y.js"}, "scripts": {"main": "no"}}')
    (tmp_path / "e" / "bad.json").write_text("{nope")
    assert sorted(map(tuple, readers.read_entrypoints(spark, str(tmp_path / "e")).collect())) == [("p.json", "bin#x", "bin/x.js"), ("p.json", "exports#.#import", "./m.mjs"), ("p.json", "exports#./y", "y.js"), ("p.json", "main", "a.js")]
    (tmp_path / "lock.json").write_text('{"packages": {"": {"version": "0"}, "node_modules/x": {"version": "1.0.1"}, "node_modules/x/node_modules/@s/y": {"version": "2"}}}')
    assert sorted(map(tuple, readers.read_lockfiles(spark, str(tmp_path / "lock.json")).collect())) == [("lock.json", "@s/y", "2"), ("lock.json", "x", "1.0.1")]
    (tmp_path / "req.txt").write_text("# all\n-r other.txt\nA_b[extra] == 1.2 ; python_version > '3'\nc>=1,<2  # why\n\nd\n")
    got = readers.read_requirements(spark, str(tmp_path / "req.txt")).select("name", "specifier", "pinned")
    assert sorted(map(tuple, got.collect())) == [("a-b", "==1.2", "1.2"), ("c", ">=1,<2", None), ("d", "", None)]
    (tmp_path / "final.json").write_text('{"a.ts": {"s": {"0": 2, "1": 0}}, "b.ts": {"s": {}}}')
    assert sorted(map(tuple, readers.read_coverage_final(spark, str(tmp_path / "final.json")).collect())) == [("a.ts", 2, 1, 50.0), ("b.ts", 0, 0, 0.0)]


def test_requirements_that_include_others(spark, tmp_path):
    files = {
        "req.txt": "a==1\n-r deep/two.txt\n--constraint=limits.txt # why\n-r../outside.txt\n-r https://x/y.txt\n-e .\n--index-url x\n",
        "deep/two.txt": "b>=2\n-r 'three more.txt'\n-r ../req.txt\n--requirement missing.txt\n-rfour.txt\n", "deep/three more.txt": "c\n-r two.txt", "deep/four.txt": "d===4",
        "limits.txt": "a<2\n-r deep/four.txt\n", "outside.txt": "z",
    }
    for name, text in files.items():
        at = tmp_path / "in" / name if name != "outside.txt" else tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    got = readers.read_requirements(spark, str(tmp_path / "in" / "req.txt")).collect()
    assert sorted((r["name"], r["specifier"], r["pinned"], r["source"].split("/in/")[1], r["kind"]) for r in got) == [
        ("a", "<2", None, "limits.txt", "constraint"), ("a", "==1", "1", "req.txt", "requirement"), ("b", ">=2", None, "deep/two.txt", "requirement"),
        ("c", "", None, "deep/three more.txt", "requirement"), ("d", "===4", "4", "deep/four.txt", "constraint"), ("d", "===4", "4", "deep/four.txt", "requirement"),
    ]
    wide = readers.read_requirements(spark, str(tmp_path / "in" / "req.txt"), root=str(tmp_path))
    assert "z" in {r["name"] for r in wide.collect()}


def test_scan_files(spark, tmp_path):
    files = {"src/a.PY": "abc", "src/deep/.env": "k", "src/__init__.py": "", ".github/w.yml": "on", "_x/b.py": "1", "node_modules/x/i.js": "1", "lib.egg-info/p": "1", ".DS_Store": "", "README": "r", "a b/ü.md": "é"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = sorted(map(tuple, readers.scan_files(spark, str(tmp_path)).collect()))
    assert rows == [(".github/w.yml", ".github", ".yml", 2), ("README", "", "", 1), ("_x/b.py", "_x", ".py", 1), ("a b/ü.md", "a b", ".md", 2), ("src/__init__.py", "src", ".py", 0), ("src/a.PY", "src", ".py", 3), ("src/deep/.env", "src/deep", "", 1)]
    assert sorted(r["path"] for r in readers.scan_files(spark, str(tmp_path), exts=(".py",)).collect()) == ["_x/b.py", "src/__init__.py", "src/a.PY"]
    both = listing.list_files(spark, str(tmp_path / "src"), str(tmp_path / "_x"), str(tmp_path / "none"))
    assert {(r["root"].rsplit("/", 1)[1], r["path"]) for r in both.collect()} == {("src", "__init__.py"), ("src", "a.PY"), ("src", "deep/.env"), ("_x", "b.py")}


def test_sarif_documents(spark, tmp_path):
    kind = f"repo string, rule_id string, title string, severity string, category string, locations {sarif.LOCATIONS}, description string, fix_id string"
    place = lambda file, *n: (file, *n, *[None] * (4 - len(n)))
    rows = [
        ("a/b", "generic-secret", "Secret", "error", "security", [place("src\\x.ts", 3, 5), place("y", 1, None, 2, 4)], None, None), ("a/b", "generic-secret", "Another", "info", "security", [], "A \"quoted\" one", "fix-1"),
        ("a/b", "a_b", "T", "warning", "x", None, "", None), ("c", "only", "é", "info", "x", [place("z")], None, None), (None, "lost", "T", "info", "x", None, None, None),
    ]
    rows += [("big", f"r{k % 3}", "T", "info", "x", [place(f"f{k}", k)], None, None) for k in range(500)]
    for _ in range(2):
        sarif.write_sarif(spark.createDataFrame(rows, kind), str(tmp_path / "out"), tool="t", version="1.2")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a%2Fb.sarif", "big.sarif", "c.sarif"]
    log = json.loads((tmp_path / "out" / "a%2Fb.sarif").read_text())
    run = log["runs"][0]
    assert log["version"] == "2.1.0" and log["$schema"].endswith("sarif-2.1.0.json") and {k: run["tool"]["driver"][k] for k in ("name", "version")} == {"name": "t", "version": "1.2"}
    assert run["tool"]["driver"]["rules"] == [
        {"id": "a_b", "name": "AB", "shortDescription": {"text": "T"}, "defaultConfiguration": {"level": "warning"}},
        {"id": "generic-secret", "name": "GenericSecret", "shortDescription": {"text": "Another"}, "defaultConfiguration": {"level": "note"}},
    ]
    results = {r["message"]["text"]: r for r in run["results"]}
    assert results["Secret"]["locations"] == [
        {"physicalLocation": {"artifactLocation": {"uri": "src/x.ts"}, "region": {"startLine": 3, "startColumn": 5}}},
        {"physicalLocation": {"artifactLocation": {"uri": "y"}, "region": {"startLine": 1, "endLine": 2, "endColumn": 4}}},
    ]
    other = results['A "quoted" one']
    assert other["properties"] == {"category": "security", "fixAvailable": True, "fixId": "fix-1"} and other["locations"] == [{"physicalLocation": {"artifactLocation": {"uri": "."}}}]
    assert results["T"]["ruleId"] == "a_b" and results["T"]["level"] == "warning"
    big = json.loads((tmp_path / "out" / "big.sarif").read_text())["runs"][0]
    assert len(big["results"]) == 500 and len(big["tool"]["driver"]["rules"]) == 3
    sarif.write_sarif(spark.createDataFrame(rows[:0], kind), str(tmp_path / "none"))
