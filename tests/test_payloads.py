"""Paths in nested payloads."""

import json

from cartolode.operators.facts import payload_paths


def paths(spark, *payloads, **more):
    df = spark.createDataFrame([(k, p if isinstance(p, str | None) else json.dumps(p)) for k, p in enumerate(payloads)], "id int, body string")
    out = {}
    for r in payload_paths(df, "id", "body", **more).collect():
        out.setdefault(r["id"], set()).add(r["path"])
    return [out.get(k, set()) for k in range(len(payloads))]


def test_payloads(spark):
    deep = {"file": "deep.ts"}
    for _ in range(7):
        deep = {"x": deep}
    got = paths(
        spark,
        {"file": "src/a.ts", "other": "src/no.ts", "paths": ["b.py", ["c/d"], {"note": "n/o", "from": "eé.md"}], "to": 3, "added": None},
        {"files": [{"path": "a \"q\".json", "relativePath": "x\\y.go"}, "/abs.ts", "http://h/x.ts", "file://x.ts", "a/../b.ts", "a..b.ts", "has space/x", "has space.rs", "tab\t.ts", "no-ending", "UPPER.TS", "l" * 1020 + ".md", "l" * 1030 + ".md"]},
        deep, {"x": deep}, "{nope", None, "", "[]", '"file"', '{"file": "a.ts", "file2": "b.ts"}', [{"changed": ["p/q", "p/q"]}],
    )
    assert got == [
        {"src/a.ts", "b.py", "c/d", "eé.md"}, {'a "q".json', "x\\y.go", "a..b.ts", "has space.rs", "UPPER.TS", "l" * 1020 + ".md"},
        {"deep.ts"}, set(), set(), set(), set(), set(), set(), {"a.ts"}, {"p/q"},
    ]


def test_the_first_paths_of_a_payload_count(spark):
    many = {"files": [f"f{k:03}.ts" for k in range(300)], "path": "last.ts"}
    assert paths(spark, many)[0] == {f"f{k:03}.ts" for k in range(200)} and paths(spark, many, most=2)[0] == {"f000.ts", "f001.ts"}
    assert paths(spark, {"path": "z.ts"}, {"path": "z.ts"}) == [{"z.ts"}, {"z.ts"}]
