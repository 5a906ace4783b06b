"""Queries over source files written from the parts table and over leases from the orders, with the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolode.operators import endpoints, facts
from cartolode.sources.tables import table as T
from cartolode.streaming import leases

#: Of each language: the extension, what stands before, what is repeated and what stands after; {n} is the part's number, {m}
#: one of three callees.
FILES = (
    (".go", "package p\nfunc (t *T) F{n}(a int) int {\n", "\tif a > 1 && a < 9 { x.call{m}(a) }\n", "\treturn 1 // if\n}\n"),
    (".java", "public class C{n} {\n int f(int a) {\n", "  while (a > 1) { x.call{m}(a); }\n", "  return a > 2 ? 1 : 0;\n }\n}\n"),
    (".kt", "class K{n} {\n fun f(a: Int): Int {\n", "  if (a > 1) call{m}(a)\n", "  return when (a) {\n 1 -> 2\n else -> 3\n }\n }\n}\n"),
    (".rs", "pub fn r{n}(a: i32) -> i32 {\n", "  for i in 0..a { call{m}(i)?; }\n", "  match a { 1 => 2, _ => 3 }\n}\n"),
    (".rb", "class R{n}\n def f(a)\n", "  call{m}(a) unless a\n  if a then call{m}(a) end\n", " end\nend\n"),
    (".php", "<?php\nfunction p{n}($a) {\n", "  if ($a and $b) { call{m}($a); }\n", "}\n"),
    (".cs", "public class D{n} {\n public int F(int a) {\n", '  if (a > 1 || a < 0) { this.call{m}("if"); }\n', "  return a switch { 1 => 2, _ => 3 };\n }\n}\n"),
    (".swift", "public func s{n}(_ a: Int) -> Int {\n", "  guard a > 1 else { return call{m}(a) }\n", "  return 1\n}\n"),
    (".cpp", "/* if */ int c{n}(int a) {\n", "  for (;;) { call{m}(a); }\n", "  return a ? 1 : 0;\n}\n"),
)


def _files(s, d):
    """A file a part, in the language of its number, with as many branches as its size says."""
    n, m = F.col("p_partkey").cast("string"), (F.col("p_partkey") % 3).cast("string")
    of = lambda k: F.get(F.array(*(F.lit(f[k]) for f in FILES)), (F.col("p_partkey") % 9).cast("int"))
    text = F.concat(of(1), F.repeat(of(2), (F.col("p_size") % 5 + 1).cast("int")), of(3))
    return T(s, d, "part").select(F.concat(F.lit("src/m"), n, of(0)).alias("path"), F.replace(F.replace(text, F.lit("{n}"), n), F.lit("{m}"), m).alias("content"))


def _endpoints(s, d):
    """A function a part, in six forms by its size, and what its file imports by its number."""
    part = T(s, d, "part").selectExpr("p_partkey as fn", "p_size % 6 as form", "p_partkey as n")
    part = part.withColumn("path", F.expr("concat('r', n, if(form = 3, '/app/routes/a.tsx', '/src/a.ts'))"))
    of = lambda *texts: "element_at(array(" + ", ".join(f"split('{t}', ' ')" if "if(" not in t else t for t in texts) + "), cast(form + 1 as int))"
    functions = part.selectExpr(
        "fn", "path", "if(form = 3, 'loader', 'f') as name", "if(form = 0, 'app.post', null) as context_call", f"{of('query', 'exec', 'eval getInput', 'json', 'query', 'own')} as callees",
        f"{of('body', 'env', 'headers', 'params', 'x', 'y')} as references", f"{of('x', 'exec', 'eval', 'x', 'query', 'own')} as direct_calls",
        "if(form = 0, array(if(n % 2 = 0, 'db.query', 'cache.query')), array()) as member_calls", "split(if(form = 0, 'req res', 'params'), ' ') as parameters",
        "case form when 1 then if(n % 3 = 0, array('process.env', 'process.env.X'), array('process.env')) when 3 then array('params.id') end as member_references",
    )
    imports = part.where("form = 0 and n % 7 <> 0 or form = 1 and n % 4 <> 1 or form = 4 and n % 5 < 2").selectExpr(
        "path", "case form when 0 then 'express' when 1 then 'child_process' else './lib/db.js' end as spec", "split(case form when 0 then 'express' when 1 then 'exec' else 'query' end, ' ') as names"
    )
    return endpoints.tag_endpoints(functions, imports, sources=("own",))


def _claims(s, d):
    """Orders as claims of 20 days or for ever, and releases of some by id, by target and agent, and by agent."""
    rows = T(s, d, "orders").selectExpr("o_orderkey as k", "concat('repo', o_custkey % 7) as repo", "cast(o_orderkey as string) as id", "cast(o_orderdate as timestamp) as at", "cast(o_custkey % 4 as string) as agent", "concat('r', o_custkey % 5, if(o_custkey % 3 = 0, '', concat('/n', o_custkey % 40))) as target")
    claims = rows.selectExpr("repo", "id", "at", "'claim' as action", "agent", "target", "if(k % 10 = 0, null, at + make_interval(0, 0, 0, 20)) as expires_at")
    gone = lambda where, i, days, agent, target: rows.where(where).selectExpr("repo", f"{i} as id", f"at + make_interval(0, 0, 0, {days}) as at", "'release' as action", f"{agent} as agent", f"{target} as target", "cast(null as timestamp) as expires_at")
    return claims.unionByName(gone("k % 4 = 1", "id", 7, "null", "null")).unionByName(gone("k % 97 = 3", "null", 3, "agent", "target")).unionByName(gone("k % 501 = 5", "null", 1, "agent", "null"))


QUERIES = {
    "source_facts": lambda s, d: facts.extract_facts(_files(s, d)).withColumn("callees", F.array_join("callees", "|")),
    "tag_endpoints": _endpoints,
    "lease_log": lambda s, d: leases.lease_log(_claims(s, d)),
}

ORACLE_SQL = {
    # before: lines up to the function's first; each: lines and decisions of a branch; rest: lines after the branches up to the
    # function's last; tail: lines from there to the end; more: decisions besides those of branches.
    "source_facts": """
WITH l(l, ext, fn, export, before, each, points, rest, tail, more) AS (VALUES
  (0, '.go', 'T.F{n}', 'F{n}', 2, 1, 2, 2, 1, 0), (1, '.java', 'C{n}.f', 'C{n}', 2, 1, 1, 2, 2, 1), (2, '.kt', 'K{n}.f', 'K{n}', 2, 1, 1, 5, 2, 1),
  (3, '.rs', 'r{n}', 'r{n}', 1, 1, 2, 2, 1, 1), (4, '.rb', 'R{n}.f', 'R{n}', 2, 2, 1, 1, 2, 0), (5, '.php', 'p{n}', 'p{n}', 2, 1, 2, 1, 1, 0),
  (6, '.cs', 'D{n}.F', 'D{n}', 2, 1, 2, 2, 2, 1), (7, '.swift', 's{n}', 's{n}', 1, 1, 1, 2, 1, 0), (8, '.cpp', 'c{n}', 'c{n}', 1, 1, 1, 2, 1, 1)),
p AS (SELECT concat('src/m', p_partkey, ext) AS path, replace(fn, '{n}', p_partkey::VARCHAR) AS fn, replace(export, '{n}', p_partkey::VARCHAR) AS export,
    before, before + each * k + rest AS last, before + each * k + rest + tail AS lines, 1 + points * k + more AS cc, concat('call', p_partkey % 3) AS callees
  FROM (SELECT *, p_size % 5 + 1 AS k FROM part) JOIN l ON l = p_partkey % 9)
SELECT path, 'file' AS kind, path AS name, 1 AS line, lines AS end_line, cc, callees, true AS parse_ok FROM p
UNION ALL SELECT path, 'function', fn, before, last, cc, callees, true FROM p
UNION ALL SELECT path, 'export', export, NULL, NULL, NULL, '', true FROM p""",
    "lease_log": """
WITH o AS (SELECT o_orderkey AS k, concat('repo', o_custkey % 7) AS repo, o_orderkey::VARCHAR AS id, o_orderdate::TIMESTAMP AS "at", (o_custkey % 4)::VARCHAR AS agent,
    concat('r', o_custkey % 5, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE concat('/n', o_custkey % 40) END) AS target FROM orders),
r AS (SELECT repo, id, "at" + INTERVAL 7 DAY AS "at", NULL AS agent, NULL AS target FROM o WHERE k % 4 = 1
  UNION ALL SELECT repo, NULL, "at" + INTERVAL 3 DAY, agent, target FROM o WHERE k % 97 = 3
  UNION ALL SELECT repo, NULL, "at" + INTERVAL 1 DAY, agent, NULL FROM o WHERE k % 501 = 5),
named AS (SELECT o.id, r."at" FROM o JOIN r ON o.id = r.id AND r."at" >= o."at"
  UNION ALL SELECT o.id, r."at" FROM o JOIN r ON r.id IS NULL AND o.repo = r.repo AND o.agent = r.agent AND r."at" >= o."at" AND (r.target IS NULL OR r.target = o.target)),
c AS (SELECT o.*, CASE WHEN k % 10 <> 0 THEN o."at" + INTERVAL 20 DAY END AS expires, f.released FROM o LEFT JOIN (SELECT id, min("at") AS released FROM named GROUP BY id) f USING (id)),
e AS (SELECT *, CASE WHEN released IS NOT NULL AND (expires IS NULL OR released < expires) THEN 'released' WHEN expires IS NOT NULL THEN 'expired' END AS ending FROM c),
x AS (SELECT *, CASE ending WHEN 'released' THEN released WHEN 'expired' THEN expires END AS till FROM e)
SELECT repo, id, "at", 'claimed' AS event, agent, target, (SELECT count(*) FROM x b WHERE b.repo = x.repo AND b.agent <> x.agent AND (b."at" < x."at" OR b."at" = x."at" AND b.id < x.id)
    AND (b.till IS NULL OR b.till > x."at" OR b.ending = 'released' AND b.till = x."at")
    AND (b.target = x.target OR starts_with(b.target, x.target || '/') OR starts_with(x.target, b.target || '/'))) AS contenders FROM x
UNION ALL SELECT repo, id, till, ending, agent, target, 0 FROM x
  WHERE ending = 'released' OR till <= (SELECT greatest((SELECT max("at") FROM o), (SELECT max("at") FROM r)))""",
    "tag_endpoints": """
SELECT p_partkey AS fn, CASE p_size % 6 WHEN 0 THEN CASE WHEN p_partkey % 7 <> 0 THEN 'express.req.body' END
    WHEN 1 THEN CASE WHEN p_partkey % 4 = 1 OR p_partkey % 3 = 0 THEN 'env' END WHEN 2 THEN 'getInput' WHEN 3 THEN 'remix.params' WHEN 5 THEN 'own' END AS source,
  CASE p_size % 6 WHEN 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'query' END WHEN 1 THEN CASE WHEN p_partkey % 4 <> 1 THEN 'exec' END
    WHEN 2 THEN 'eval' WHEN 4 THEN CASE WHEN p_partkey % 5 < 2 THEN 'query' END END AS sink FROM part""",
}
