"""Queries of the review, flow and evidence operators over the test tables, with the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolode.operators import changes, evidence, flows, graph, history, review, rules, search
from cartolode.plans.bindings import view as V
from cartolode.plans.bindings import with_views as W
from cartolode.plans.oracle import ORACLE_SQL as BASE
from cartolode.sources.tables import sized
from cartolode.sources.tables import table as T


def R(body: str, *views: str) -> str:
    return W("", *views).replace("WITH ", "WITH RECURSIVE ").rstrip() + ", " + body


def _sides(s, d, *columns):
    return [x.selectExpr(*columns) for x in changes.split(V(s, d, "snap"))]


def _coupled(s, d):
    edges = sized(s, d, ("lineitem",), lambda: V(s, d, "edges"))
    return review.coupling_in_cycles(graph.coupling(edges), graph.cycles(edges))


def _metrics(s, d):
    return [x.groupBy("path").agg((F.max("version") * 4).alias("cc"), F.count("*").alias("fan_in")) for x in changes.split(V(s, d, "snap"))]


def _diff(s, d):
    return changes.diff_rows(*[x.groupBy("path").agg(F.max("version").alias("version")) for x in changes.split(V(s, d, "snap"))], ("path",), "version")


def _scoped(s, d):
    contract = s.sql("""SELECT * FROM VALUES (0, 'src1', 'allowed'), (0, 'src2/en', 'allowed'), (0, 'src1/de', 'forbidden'), (1, 'src3', 'forbidden'), (2, 'src4', 'allowed') AS t(contract_id, prefix, kind)""")
    return review.scope_check(V(s, d, "files").select((F.col("doc_id") % 3).alias("contract_id"), "path"), contract)


def _endpoints(s, d):
    part = T(s, d, "part")
    return [part.where(c).select(F.col("p_partkey").alias("node")) for c in ("p_size <= 2", "p_size >= 49")]


def _daily(s, d):
    return V(s, d, "runs").groupBy("run_ts").agg(F.count("*").alias("score"))


def _owner_rules(s):
    return s.sql(r"""SELECT * FROM VALUES (0, '.*', 'root'), (1, '^src1/', 'one'), (2, '/de/', 'de'), (3, '^src1/de/.*7\\.de$', 'seven') AS t(rule_no, regex, owner)""")


def _policy(s):
    return s.sql("""SELECT * FROM VALUES ('src0', array('src1/*', 'src2/en'), cast(null as array<string>)), ('src1', null, array('*/de', 'src3/en')), ('src2', null, array('*')), ('src3', array('*'), null) AS t(from_package, allow, deny)""")


def _proofs(s, d):
    return V(s, d, "ledger").groupBy(F.col("command").alias("requirement")).agg(
        F.when(F.max("event_id") % 3 == 0, "production").when(F.max("event_id") % 3 == 1, "documentation").otherwise("test").alias("surface"),
        (F.max("event_id") % 4).alias("commands"), F.count("*").alias("matched"), F.count_if(F.expr("exit_code = 1 and event_id % 97 = 0")).alias("fresh_failed"),
        F.count_if(F.expr("exit_code = 0 and event_id % 50 = 0")).alias("fresh_passed"), F.count_if(F.expr("exit_code = 0 and event_id % 100 = 0")).alias("trusted"),
        F.count_if(F.expr("event_id % 7 = 0")).alias("stale"), F.count_if(F.expr("event_id % 60 = 0")).alias("touched"), (F.max("event_id") % 5 > 1).alias("tested"),
    )


def _exports(s, d):
    return T(s, d, "part").select(F.col("p_brand").alias("repo"), F.col("p_name").alias("symbol"))


def _file_totals(s, d, where):
    return V(s, d, "files").where(where).groupBy("dir").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


QUERIES = {
    "diff_metrics": lambda s, d: review.diff_metrics(*_metrics(s, d)),
    "diff_cycles": lambda s, d: sized(s, d, ("lineitem",), lambda: review.diff_cycles(*_sides(s, d, "path as node", "fact as component"))),
    "risky_changes": lambda s, d: review.risky_changes(*_sides(s, d, "path", "fact % 5 as name", "version * 3 as cc")),
    "review_files": lambda s, d: review.review_files(_diff(s, d), V(s, d, "coverage").withColumnRenamed("pct", "risk")),
    "review_totals": lambda s, d: review.review_totals(_diff(s, d).select((F.col("path") % 4).alias("tier"), "status")),
    "diff_dependencies": lambda s, d: review.diff_dependencies(*[x.groupBy(F.col("path").alias("manifest"), (F.col("fact") % 7).alias("name")).agg(F.max("version").alias("version"), (F.min("fact") % 2).alias("kind")) for x in changes.split(V(s, d, "snap"))]),
    "scope_check": _scoped,
    "scope_status": lambda s, d: review.scope_status(_scoped(s, d)),
    "trend": lambda s, d: review.trend(_daily(s, d)),
    "chunks": lambda s, d: review.chunks(V(s, d, "files").select("dir", "doc_id"), ["doc_id"], 20, ("dir",)),
    "coupling_view": _coupled,
    "read_targets": lambda s, d: review.read_targets(T(s, d, "part").selectExpr("p_partkey as path", "p_size * 20000 as size_bytes", "p_size"), sized(s, d, ("lineitem",), lambda: history.churn(V(s, d, "commits"))), F.col("p_size") != 7),
    "path_search": lambda s, d: review.path_search(V(s, d, "files").select("path"), "SRC1/"),
    "embed_plan": lambda s, d: review.embed_plan(*changes.split(V(s, d, "snap")), ("path", "fact"), "version"),
    "collisions_transitive": lambda s, d: sized(s, d, ("lineitem",), lambda: flows.collisions_transitive(V(s, d, "work"), V(s, d, "edges"))),
    "taint_flows": lambda s, d: flows.taint_flows(V(s, d, "edges"), *_endpoints(s, d)),
    "dataflow_bridges": lambda s, d: flows.dataflow_bridges(V(s, d, "edges"), *_endpoints(s, d)),
    "reexport_closure": lambda s, d: flows.expand_reexports(T(s, d, "part").selectExpr("p_partkey as path", "p_name as name"), V(s, d, "edges")),
    "graph_query_importers": lambda s, d: flows.neighbours(V(s, d, "edges"), T(s, d, "part").where("p_size < 5").selectExpr("p_partkey as path")),
    "graph_query_imports": lambda s, d: flows.neighbours(V(s, d, "edges"), T(s, d, "part").where("p_size < 5").selectExpr("p_partkey as path"), "imports"),
    "resolve_imports": lambda s, d: flows.resolve_imports(V(s, d, "files").select("path", F.concat("dir", F.lit("/"), "ext", F.lit("/"), (F.col("doc_id") + 20).cast("string")).alias("spec")), V(s, d, "files"), ["", ".en", ".de", ".fr", ".es"]),
    "proof_sufficiency": lambda s, d: evidence.proof_sufficiency(_proofs(s, d)),
    "coordination": lambda s, d: evidence.coordination(changes.collisions_same(V(s, d, "work")), changes.collisions_dep(V(s, d, "work"), V(s, d, "edges")), changes.contended_claims(V(s, d, "claims"))),
    "risk_delta": lambda s, d: evidence.risk_delta(rules.health_score(V(s, d, "issues")).select("source", "score", "errors", "warnings"), 15 * F.col("errors") + 5 * F.col("warnings"), 10 * F.col("errors")).select("source", "baseline", "projected", "delta"),
    "release_scale": lambda s, d: evidence.release_scale(V(s, d, "work"), "stream", 25),
    "baseline_totals": lambda s, d: evidence.baseline_totals(V(s, d, "feedback").select(F.when(F.col("useful"), "passed").when(F.col("noisy"), "failed").otherwise("running").alias("status"), "minutes")),
    "metric_regressions": lambda s, d: evidence.metric_regressions(_file_totals(s, d, "true"), _file_totals(s, d, "ext <> 'fr' and dir <> 'src3'"), "dir", ("files",), ("bytes",)),
    "accepted_hotspots": lambda s, d: evidence.accepted_hotspots(V(s, d, "runs").withColumnRenamed("rule_id", "path")),
    "signal_counts": lambda s, d: evidence.signal_counts(V(s, d, "feedback")),
    "validation_rollup": lambda s, d: evidence.validation_rollup(V(s, d, "feedback"), 10),
    "owner_last_match": lambda s, d: evidence.owners_of(V(s, d, "files"), _owner_rules(s)),
    "policy_violations": lambda s, d: evidence.policy_violations(T(s, d, "documents").select(F.col("source").alias("from_package"), F.concat(F.lit("src"), (F.col("doc_id") % 7).cast("string"), F.lit("/"), "lang").alias("to_package")).distinct(), _policy(s)),
    "issues_suppressed": lambda s, d: evidence.suppress(V(s, d, "issues"), s.sql("SELECT * FROM VALUES ('licence-line', '^src1'), ('large-document', '[02468]$') AS t(rule, regex)"), "source"),
    "diff_contracts": lambda s, d: sized(s, d, ("lineitem",), lambda: review.diff_contracts(*_sides(s, d, "path", "fact as name"), T(s, d, "part").where("p_size <= 20").selectExpr("p_partkey as path"))),
    "route_texts": lambda s, d: search.route_texts(T(s, d, "documents"), s.sql("SELECT * FROM VALUES ('english', 0, 'the', 2), ('english', 0, 'of', 1), ('german', 1, 'und', 2), ('german', 1, 'der', 1), ('legal', 2, 'license', 3), ('french', 3, 'les', 2), ('french', 3, 'de', 1) AS t(route, place, keyword, weight)")),
    "known_bad_join": lambda s, d: evidence.known_bad(T(s, d, "part").selectExpr("p_partkey", "p_brand as name", "p_size as version"), s.sql("SELECT * FROM VALUES ('Brand#11', 7), ('Brand#23', 12), ('Brand#45', 49) AS t(name, version)")),
    "recipe_match": lambda s, d: evidence.match_recipes(V(s, d, "files"), s.sql("SELECT * FROM VALUES ('ends', '1[.](en|de)$'), ('first', '^src1/') AS t(recipe, regex)")),
    "issues_touching": lambda s, d: rules.changed_only(V(s, d, "issues"), T(s, d, "labels").where("quality = 1"), "doc_id"),
    "changed_after_proof": lambda s, d: evidence.changed_after_proof(T(s, d, "lineitem").selectExpr("l_orderkey as proof", "l_partkey as path", "l_shipdate as proved_at"), V(s, d, "commits")),
    "guard_status": lambda s, d: evidence.guard_status(V(s, d, "cost").selectExpr("event_id as contract_id", "user_id % 7 <> 0 as has_contract", "cast(tokens % 9 = 0 as int) as forbidden", "cast(tokens % 8 = 0 as int) as outside", "cast(user_id % 6 = 0 as int) as changed_after", "element_at(array('passed', 'failed', 'stale'), cast(tokens % 3 + 1 as int)) as proof", "if(tool = 'error', 'weak', 'strong') as sufficiency")),
    "corpus_metrics": lambda s, d: evidence.corpus_metrics(V(s, d, "funcs").selectExpr("file", "cc", "1 as functions"), "file", ("cc", "functions")),
    "shared_symbols": lambda s, d: evidence.shared_symbols(_exports(s, d)),
    "cross_repo_callers": lambda s, d: evidence.cross_repo_callers(_exports(s, d), T(s, d, "part").selectExpr("p_brand as repo", "p_name as symbol")),
    "outdated": lambda s, d: evidence.outdated(T(s, d, "part").selectExpr("p_partkey as name", "if(p_partkey % 11 = 0, '*', concat('^', p_size % 3, '.', p_size % 5, '.', p_partkey % 2)) as declared"), T(s, d, "part").where("p_partkey % 13 <> 0").selectExpr("p_partkey as name", "concat(p_size % 2, '.', p_size % 5, '.', p_partkey % 3) as installed")).select("name", "drift"),
    "secret_scan": lambda s, d: evidence.secret_scan(T(s, d, "documents")),
    "excerpts": lambda s, d: evidence.excerpts(T(s, d, "documents"), ["licen", "TOKEN"]),
    "chunk_hash": lambda s, d: evidence.chunk_hash(T(s, d, "documents"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")), F.col("text")),
    "sarif_results": lambda s, d: evidence.sarif_results(V(s, d, "issues"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))),
}

_MET = "met AS (SELECT snapshot, path, max(version) * 4 AS cc, count(*) AS fan_in FROM snap GROUP BY 1, 2)"
_CHG = """chg AS (SELECT coalesce(b.path, h.path) AS path, CASE WHEN b.v IS NULL THEN 'added' WHEN h.v IS NULL THEN 'removed' WHEN b.v <> h.v THEN 'modified' END AS status
 FROM (SELECT path, max(version) AS v FROM snap WHERE snapshot = 'base' GROUP BY 1) b FULL JOIN (SELECT path, max(version) AS v FROM snap WHERE snapshot = 'head' GROUP BY 1) h ON b.path = h.path)"""
_SCOPE = """ct AS (SELECT * FROM (VALUES (0, 'src1', 'allowed'), (0, 'src2/en', 'allowed'), (0, 'src1/de', 'forbidden'), (1, 'src3', 'forbidden'), (2, 'src4', 'allowed')) t(c, p, k)),
 scoped AS (SELECT doc_id % 3 AS contract_id, path, CASE
   WHEN EXISTS (SELECT 1 FROM ct WHERE c = doc_id % 3 AND k = 'forbidden' AND (path = p OR starts_with(path, p || '/'))) THEN 'forbidden'
   WHEN EXISTS (SELECT 1 FROM ct WHERE c = doc_id % 3 AND k = 'allowed' AND (path = p OR starts_with(path, p || '/'))) OR NOT EXISTS (SELECT 1 FROM ct WHERE c = doc_id % 3 AND k = 'allowed') THEN 'allowed'
   ELSE 'outside' END AS scope FROM files)"""
_FAR = """far AS (SELECT path AS seed, path AS node, 0 AS hop FROM (SELECT DISTINCT path FROM work) UNION SELECT seed, src, hop + 1 FROM far JOIN edges ON dst = node WHERE hop < 5),
 near AS (SELECT seed, node, min(hop) AS hop FROM far GROUP BY 1, 2),
 hits AS (SELECT x.stream AS s, y.stream AS t, seed, node, hop FROM near JOIN work x ON x.path = seed JOIN work y ON y.path = node WHERE hop >= 2 AND x.stream <> y.stream
   AND NOT EXISTS (SELECT 1 FROM work w WHERE w.path = seed AND w.stream = y.stream) AND NOT EXISTS (SELECT 1 FROM work w WHERE w.path = node AND w.stream = x.stream))"""
_WAYS = """ways AS (SELECT p_partkey AS source, p_partkey AS node, [p_partkey] AS path, false AS ended FROM part WHERE p_size <= 2
  UNION ALL SELECT source, dst, list_append(path, dst), p_size >= 49 FROM ways JOIN edges ON src = node JOIN part ON p_partkey = dst WHERE NOT ended AND NOT list_contains(path, dst) AND len(path) <= 12)"""
_NEAR3 = """near3 AS (SELECT p_partkey AS seed, p_partkey AS node, 0 AS hop FROM part WHERE p_size <= 2 OR p_size >= 49 UNION SELECT seed, src, hop + 1 FROM near3 JOIN edges ON dst = node WHERE hop < 3),
  firsts AS (SELECT seed, node, min(hop) AS hop, any_value(p_size) AS size FROM near3 JOIN part ON p_partkey = seed GROUP BY 1, 2),
  picked AS (SELECT node, size <= 2 AS is_source, seed, row_number() OVER (PARTITION BY node, size <= 2 ORDER BY hop, seed) AS n FROM firsts WHERE hop >= 1)"""
_LOOK = "SELECT {a} AS path, {b} AS neighbour FROM edges JOIN part ON p_partkey = {a} WHERE p_size < 5"
_TOTALS = "SELECT dir, count(*) AS files, sum(size_bytes) AS bytes FROM files WHERE {w} GROUP BY dir"
_FIT = "len(list_filter({l}, lambda p: p = '*' OR p = to_package OR (p LIKE '%/*' AND starts_with(to_package, left(p, length(p) - 1))) OR (p LIKE '*/%' AND suffix(to_package, substr(p, 2))))) > 0"

ORACLE_SQL = {
    "diff_metrics": W("", "snap").rstrip() + ", " + _MET + " SELECT b.path, h.cc - b.cc AS cc_delta, h.fan_in - b.fan_in AS fan_in_delta FROM met b JOIN met h ON b.path = h.path AND b.snapshot = 'base' AND h.snapshot = 'head' WHERE h.cc <> b.cc OR h.fan_in <> b.fan_in",
    "diff_cycles": W("""SELECT component, size, overlap, CASE WHEN overlap = 0 THEN 'new' ELSE 'expanded' END AS classification FROM (
        SELECT fact AS component, count(*) AS size, coalesce((SELECT max(n) FROM (SELECT b.fact, count(*) AS n FROM snap b JOIN snap g ON b.path = g.path WHERE b.snapshot = 'base' AND g.snapshot = 'head' AND g.fact = h.fact GROUP BY b.fact) z), 0) AS overlap
        FROM snap h WHERE snapshot = 'head' GROUP BY fact) t WHERE overlap < size""", "snap"),
    "risky_changes": W("", "snap").rstrip() + """, f AS (SELECT snapshot, path, fact % 5 AS name, version * 3 AS cc, count(*) OVER (PARTITION BY snapshot, path, fact % 5) AS n FROM snap),
        j AS (SELECT h.path, h.name, h.cc, h.n, b.n AS m, b.cc AS old FROM (SELECT * FROM f WHERE snapshot = 'head') h LEFT JOIN (SELECT path, name, min(cc) AS cc, count(*) AS n FROM f WHERE snapshot = 'base' GROUP BY 1, 2) b ON b.path = h.path AND b.name = h.name)
        SELECT path, name, cc, CASE WHEN m = 1 AND n = 1 THEN old END AS base_cc, CASE WHEN m IS NULL THEN 'added' WHEN old < 10 AND cc >= 10 THEN 'crossed-threshold' ELSE 'jumped' END AS reason
        FROM j WHERE (m IS NULL AND cc >= 10) OR (m = 1 AND n = 1 AND ((old < 10 AND cc >= 10) OR cc - old >= 5))""",
    "review_files": W("", "snap", "coverage").rstrip() + ", " + _CHG + " SELECT chg.path, status, CASE WHEN status <> 'removed' THEN pct END AS risk FROM chg LEFT JOIN coverage c ON c.path = chg.path WHERE status IS NOT NULL",
    "review_totals": W("", "snap").rstrip() + ", " + _CHG + " SELECT path % 4 AS tier, count(*) FILTER (WHERE status = 'added') AS added, count(*) FILTER (WHERE status = 'removed') AS removed, count(*) FILTER (WHERE status = 'modified') AS modified FROM chg WHERE status IS NOT NULL GROUP BY 1",
    "diff_dependencies": W("", "snap").rstrip() + """, deps AS (SELECT snapshot, path AS manifest, fact % 7 AS name, max(version) AS version, min(fact) % 2 AS kind FROM snap GROUP BY 1, 2, 3)
        SELECT * FROM (SELECT coalesce(b.manifest, h.manifest) AS manifest, coalesce(b.name, h.name) AS name, b.version AS old_version, h.version AS version,
          CASE WHEN b.version IS NULL THEN 'added' WHEN h.version IS NULL THEN 'removed' WHEN b.version <> h.version THEN 'bumped' WHEN b.kind <> h.kind THEN 'moved' END AS change
          FROM (SELECT * FROM deps WHERE snapshot = 'base') b FULL JOIN (SELECT * FROM deps WHERE snapshot = 'head') h ON b.manifest = h.manifest AND b.name = h.name) t WHERE change IS NOT NULL""",
    "scope_check": W("", "files").rstrip() + ", " + _SCOPE + " SELECT * FROM scoped",
    "scope_status": W("", "files").rstrip() + ", " + _SCOPE + " SELECT contract_id, count(*) FILTER (WHERE scope = 'forbidden') AS forbidden, count(*) FILTER (WHERE scope = 'outside') AS outside, CASE WHEN count(*) FILTER (WHERE scope <> 'allowed') > 0 THEN 'drifted' ELSE 'inside' END AS status FROM scoped GROUP BY 1",
    "trend": W("SELECT *, CASE WHEN delta > 0 THEN 'up' WHEN delta < 0 THEN 'down' WHEN delta = 0 THEN 'flat' END AS direction, -delta AS risk_delta, CASE WHEN delta > 0 THEN 'down' WHEN delta < 0 THEN 'up' WHEN delta = 0 THEN 'flat' END AS risk_direction FROM (SELECT run_ts, n AS score, n - lag(n) OVER (ORDER BY run_ts) AS delta FROM (SELECT run_ts, count(*) AS n FROM runs GROUP BY 1) a) b", "runs"),
    "chunks": W("SELECT dir, doc_id, (row_number() OVER (PARTITION BY dir ORDER BY doc_id) - 1) // 20 AS chunk FROM files", "files"),
    "coupling_view": f"SELECT c.* FROM ({BASE['coupling']}) c WHERE path IN (SELECT node FROM ({BASE['cycles']}) k)",
    "read_targets": W("SELECT p_partkey AS path, p_size * 20000 AS size_bytes, coalesce(churn, 0) AS churn, greatest(1, floor(p_size * 20000 / 40 + 0.5)) AS lines FROM part LEFT JOIN (SELECT path, count(DISTINCT commit_hash) AS churn FROM commits GROUP BY 1) c ON c.path = p_partkey WHERE p_size <> 7 AND p_size * 20000 <= 524288 ORDER BY churn DESC, size_bytes DESC, p_partkey LIMIT 400", "commits"),
    "path_search": W("SELECT path FROM files WHERE contains(lower(path), 'src1/') ORDER BY path LIMIT 50", "files"),
    "embed_plan": W("""SELECT coalesce(b.path, h.path) AS path, coalesce(b.fact, h.fact) AS fact, CASE WHEN h.path IS NULL THEN 'drop' WHEN b.path IS NULL OR b.version IS DISTINCT FROM h.version THEN 'embed' ELSE 'keep' END AS action
        FROM (SELECT * FROM snap WHERE snapshot = 'base') b FULL JOIN (SELECT * FROM snap WHERE snapshot = 'head') h ON b.path = h.path AND b.fact = h.fact""", "snap"),
    "collisions_transitive": R(_FAR + " SELECT least(s, t) AS stream_a, greatest(s, t) AS stream_b, CASE WHEN s < t THEN seed ELSE node END AS file_a, CASE WHEN s < t THEN node ELSE seed END AS file_b, min(hop) AS distance FROM hits GROUP BY 1, 2, 3, 4", "work", "edges"),
    "taint_flows": R(_WAYS + " SELECT source, sink, depth, path FROM (SELECT source, node AS sink, len(path) - 1 AS depth, array_to_string(path, '>') AS path, row_number() OVER (PARTITION BY source, node ORDER BY len(path), path) AS n FROM ways WHERE ended) z WHERE n = 1", "edges"),
    "dataflow_bridges": R(_NEAR3 + " SELECT a.node AS bridge, a.seed AS source, b.seed AS sink FROM picked a JOIN picked b ON a.node = b.node AND a.is_source AND NOT b.is_source AND a.n = 1 AND b.n = 1 JOIN part ON p_partkey = a.node WHERE p_size > 2 AND p_size < 49", "edges"),
    "reexport_closure": R("names AS (SELECT p_partkey AS path, p_name AS name FROM part UNION SELECT src, name FROM names JOIN edges ON dst = path) SELECT DISTINCT path, name FROM names", "edges"),
    "graph_query_importers": W(_LOOK.format(a="dst", b="src"), "edges"),
    "graph_query_imports": W(_LOOK.format(a="src", b="dst"), "edges"),
    "resolve_imports": W("""SELECT path, spec, target, CASE WHEN target IS NULL THEN split_part(spec, '/', 1) END AS package FROM (
        SELECT f.path, concat(f.dir, '/', f.ext, '/', CAST(f.doc_id + 20 AS VARCHAR)) AS spec, g.path AS target FROM (SELECT DISTINCT path, dir, ext, doc_id FROM files) f
        LEFT JOIN (SELECT DISTINCT path FROM files) g ON g.path IN (concat(f.dir, '/', f.ext, '/', CAST(f.doc_id + 20 AS VARCHAR), '.en'), concat(f.dir, '/', f.ext, '/', CAST(f.doc_id + 20 AS VARCHAR), '.de'), concat(f.dir, '/', f.ext, '/', CAST(f.doc_id + 20 AS VARCHAR), '.fr'), concat(f.dir, '/', f.ext, '/', CAST(f.doc_id + 20 AS VARCHAR), '.es'))) t""", "files"),
    "proof_sufficiency": W("", "ledger").rstrip() + """, e AS (SELECT command, max(event_id) % 3 AS surface, max(event_id) % 4 AS commands, count(*) FILTER (WHERE exit_code = 1 AND event_id % 97 = 0) AS failed, count(*) FILTER (WHERE exit_code = 0 AND event_id % 50 = 0) AS passed,
        count(*) FILTER (WHERE exit_code = 0 AND event_id % 100 = 0) AS trusted, count(*) FILTER (WHERE event_id % 7 = 0) AS stale, count(*) FILTER (WHERE event_id % 60 = 0) AS touched, max(event_id) % 5 > 1 AS tested FROM ledger GROUP BY 1)
        SELECT command AS requirement, CASE WHEN failed > 0 THEN 'failed' WHEN commands = 0 THEN CASE WHEN surface = 1 THEN 'adequate' ELSE 'weak' END WHEN passed = 0 THEN CASE WHEN stale > 0 THEN 'stale' ELSE 'missing' END
        WHEN trusted = 0 THEN 'weak' WHEN surface = 0 THEN CASE WHEN touched = 0 THEN 'weak' WHEN tested THEN 'strong' ELSE 'adequate' END WHEN touched > 0 THEN 'strong' ELSE 'adequate' END AS status FROM e""",
    "coordination": f"SELECT *, CASE WHEN high > 0 OR contended > 0 THEN 'conflicted' WHEN medium > 0 THEN 'caution' ELSE 'clear' END AS readiness FROM (SELECT (SELECT count(*) FROM ({BASE['collisions_same']}) a) AS high, (SELECT count(*) FROM ({BASE['collisions_dep']}) b) AS medium, (SELECT count(*) FROM ({BASE['claims_contended']}) c) AS contended) t",
    "risk_delta": f"""SELECT source, baseline, least(100, baseline + 10 * errors) AS projected, least(100, baseline + 10 * errors) - baseline AS delta
        FROM (SELECT source, errors, greatest(0, least(100, score - 15 * errors - 5 * warnings)) AS baseline FROM ({BASE['health_score']}) h) t""",
    "release_scale": W("SELECT stream, count(DISTINCT path) AS changed, count(DISTINCT path) > 25 AS release_scale FROM work GROUP BY 1", "work"),
    "baseline_totals": W("SELECT count(*) AS runs, count(*) FILTER (WHERE useful) AS passed, count(*) FILTER (WHERE NOT useful AND noisy) AS failed, sum(minutes) AS minutes, floor(count(*) FILTER (WHERE useful) / count(*) * 100 + 0.5) / 100 AS completion FROM feedback", "feedback"),
    "metric_regressions": W("", "files").rstrip() + f", b AS ({_TOTALS.format(w='true')}), c AS (" + _TOTALS.format(w="ext <> 'fr' AND dir <> 'src3'") + """)
        SELECT dir, 'missing' AS metric, NULL AS before, NULL AS after FROM b WHERE dir NOT IN (SELECT dir FROM c)
        UNION ALL SELECT b.dir, 'files', b.files, c.files FROM b JOIN c ON b.dir = c.dir WHERE c.files < b.files UNION ALL SELECT b.dir, 'bytes', b.bytes, c.bytes FROM b JOIN c ON b.dir = c.dir WHERE c.bytes > b.bytes""",
    "accepted_hotspots": W("""SELECT path, run_count, age_days FROM (SELECT rule_id AS path, count(DISTINCT run_ts) AS run_count, datediff('day', min(run_ts), (SELECT max(run_ts) FROM runs)) AS age_days, datediff('day', max(run_ts), (SELECT max(run_ts) FROM runs)) AS quiet FROM runs GROUP BY 1) t
        WHERE run_count >= 5 AND age_days >= 7 AND quiet <= 90""", "runs"),
    "signal_counts": W("SELECT * FROM (SELECT 'useful' AS signal, count(*) AS n FROM feedback WHERE useful UNION ALL SELECT 'noisy', count(*) FROM feedback WHERE noisy) t WHERE n > 0", "feedback"),
    "validation_rollup": W("SELECT *, repos >= 10 AND useful >= 3 AND mean_minutes >= 10 AS ready FROM (SELECT count(*) AS repos, sum(n) AS responses, sum(good) AS useful, sum(m) AS minutes, max(m) AS most_minutes, floor(sum(m) / sum(n) * 100 + 0.5) / 100 AS mean_minutes FROM (SELECT repo, count(*) AS n, count(*) FILTER (WHERE useful) AS good, sum(minutes) AS m FROM feedback GROUP BY 1) a) b", "feedback"),
    "owner_last_match": W(r"SELECT DISTINCT path, CASE WHEN regexp_matches(path, '^src1/de/.*7\.de$') THEN 'seven' WHEN contains(path, '/de/') THEN 'de' WHEN starts_with(path, 'src1/') THEN 'one' ELSE 'root' END AS owner FROM files WHERE path IS NOT NULL", "files"),
    "policy_violations": f"""SELECT DISTINCT from_package, to_package FROM (SELECT source AS from_package, concat('src', CAST(doc_id % 7 AS VARCHAR), '/', lang) AS to_package FROM documents) e
        WHERE (from_package = 'src0' AND NOT {_FIT.format(l="['src1/*', 'src2/en']")}) OR (from_package = 'src1' AND {_FIT.format(l="['*/de', 'src3/en']")}) OR from_package = 'src2'""",
    "issues_suppressed": W("SELECT * FROM issues WHERE NOT (rule_id = 'licence-line' AND coalesce(starts_with(source, 'src1'), false)) AND NOT (rule_id = 'large-document' AND coalesce(regexp_matches(source, '[02468]$'), false))", "issues"),
    "diff_contracts": W("""SELECT x.path, x.fact AS name, CASE x.snapshot WHEN 'head' THEN 'added' ELSE 'removed' END AS change FROM (SELECT DISTINCT snapshot, path, fact FROM snap) x JOIN part ON p_partkey = x.path
        WHERE p_size <= 20 AND NOT EXISTS (SELECT 1 FROM snap y WHERE y.path = x.path AND y.fact = x.fact AND y.snapshot <> x.snapshot)""", "snap"),
    "route_texts": """WITH cat AS (SELECT * FROM (VALUES ('english', 0, 'the', 2), ('english', 0, 'of', 1), ('german', 1, 'und', 2), ('german', 1, 'der', 1), ('legal', 2, 'license', 3), ('french', 3, 'les', 2), ('french', 3, 'de', 1)) t(route, place, keyword, weight)),
        hits AS (SELECT doc_id, route, place, sum(weight) AS score FROM documents JOIN cat ON regexp_matches(lower(text), concat('(^|[^a-z0-9])', keyword, '([^a-z0-9]|$)')) GROUP BY 1, 2, 3)
        SELECT doc_id, route, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS n FROM hits) t WHERE n = 1""",
    "known_bad_join": "SELECT p_partkey, p_brand AS name, p_size AS version FROM part WHERE (p_brand = 'Brand#11' AND p_size = 7) OR (p_brand = 'Brand#23' AND p_size = 12) OR (p_brand = 'Brand#45' AND p_size = 49)",
    "recipe_match": W("SELECT DISTINCT path, 'ends' AS recipe FROM files WHERE suffix(path, '1.en') OR suffix(path, '1.de') UNION ALL SELECT DISTINCT path, 'first' FROM files WHERE starts_with(path, 'src1/')", "files"),
    "issues_touching": W("SELECT * FROM issues WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)", "issues"),
    "changed_after_proof": W("SELECT proof, covered, changed, CASE WHEN changed > 0 THEN 'stale' ELSE 'current' END AS status FROM (SELECT l_orderkey AS proof, count(*) AS covered, count(*) FILTER (WHERE m > l_shipdate) AS changed FROM lineitem LEFT JOIN (SELECT path, max(ts) AS m FROM commits GROUP BY 1) c ON c.path = l_partkey GROUP BY 1) t", "commits"),
    "guard_status": W("SELECT event_id AS contract_id, CASE WHEN user_id % 7 = 0 THEN 'blocked' WHEN tokens % 9 = 0 OR tokens % 8 = 0 OR user_id % 6 = 0 THEN 'drift' WHEN tokens % 3 = 1 THEN 'blocked' WHEN tokens % 3 = 2 OR tool = 'error' THEN 'attention' ELSE 'clear' END AS status FROM cost", "cost"),
    "corpus_metrics": "SELECT p_brand AS file, sum(p_size) AS cc, count(*) AS functions FROM part GROUP BY ROLLUP (p_brand)",
    "shared_symbols": "SELECT p_name AS symbol, count(DISTINCT p_brand) AS repos FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) >= 2 ORDER BY 2 DESC, 1 LIMIT 200",
    "cross_repo_callers": "SELECT DISTINCT a.p_name AS symbol, a.p_brand AS repo, b.p_brand AS caller FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand <> b.p_brand",
    "outdated": """SELECT p_partkey AS name, CASE WHEN p_partkey % 11 = 0 OR p_partkey % 13 = 0 THEN 'unknown' WHEN p_size % 3 <> p_size % 2 THEN 'major' WHEN p_partkey % 2 <> p_partkey % 3 THEN 'patch' ELSE 'same' END AS drift FROM part""",
    "secret_scan": "SELECT * FROM (SELECT doc_id, CASE " + " ".join("WHEN regexp_matches(text, '" + p.replace("'", "''") + f"') THEN '{n}'" for n, p in evidence.SECRETS) + " END AS secret FROM documents) t WHERE secret IS NOT NULL",
    "excerpts": r"""SELECT doc_id, line, substring(regexp_replace(x, '^\s+|\s+$', '', 'g'), 1, 200) AS excerpt FROM (SELECT doc_id, line, x, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS n FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) a WHERE contains(lower(x), 'licen') OR contains(lower(x), 'token')) b WHERE n = 1""",
    "chunk_hash": "SELECT path, chunk, sha256(concat_ws(chr(10), path, substring(t, chunk * 4096 + 1, 4096))) AS digest FROM (SELECT path, t, unnest(range(0, greatest(length(t) - 1, 0) // 4096 + 1)) AS chunk FROM (SELECT concat(source, '/', CAST(doc_id AS VARCHAR)) AS path, coalesce(text, '') AS t FROM documents) a) b",
    "sarif_results": W("SELECT rule_id, CASE rule_id WHEN 'generic-secret' THEN 'GenericSecret' WHEN 'long-number' THEN 'LongNumber' WHEN 'licence-line' THEN 'LicenceLine' ELSE 'LargeDocument' END AS rule_name, CASE severity WHEN 'info' THEN 'note' ELSE severity END AS level, concat(source, '/', CAST(doc_id AS VARCHAR)) AS uri, category FROM issues", "issues"),
}
