"""Queries of the planning, dependency and fact operators over the test tables, with the SQL that they are held against."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from cartolode.functions import scalar
from cartolode.operators import changes, facts, flows, graph, planning, rules, search, supply
from cartolode.plans.bindings import view as V
from cartolode.plans.bindings import with_views as W
from cartolode.plans.oracle import ORACLE_SQL as BASE
from cartolode.plans.oracle import _terms as terms
from cartolode.plans.reviews import ORACLE_SQL as REVIEWS
from cartolode.sources.tables import sized
from cartolode.sources.tables import table as T
from cartolode.streaming import state

COMMANDS = {"click": "doctor", "view": "review", "error": "evidence"}


def _deps(s, d):
    """Parts as packages of the workspace of their brand."""
    return T(s, d, "part").selectExpr(
        "p_brand as workspace", "element_at(array('moment', 'lodash', 'vite', '@types/node', 'express', 'left', 'jquery', 'react'), cast(p_partkey % 8 + 1 as int)) as known",
        "if(p_partkey % 8 = 5, concat('left-', p_partkey), element_at(array('moment', 'lodash', 'vite', '@types/node', 'express', 'left', 'jquery', 'react'), cast(p_partkey % 8 + 1 as int))) as name",
        "if(p_size % 9 = 0, '*', if(p_size % 9 = 1, '>=1.0.0', '^1.2.3')) as version", "p_size % 4 = 0 as dev",
        "element_at(array('MIT', 'GPL-3.0', 'Apache-2.0', 'LGPL', null), cast(p_size % 5 + 1 as int)) as licence", "if(p_size % 7 = 0, null, p_size * 1000 + p_partkey) as bytes",
    )


_DEPS = """deps AS (SELECT p_brand AS workspace, CASE WHEN p_partkey % 8 = 5 THEN concat('left-', p_partkey) ELSE ['moment', 'lodash', 'vite', '@types/node', 'express', 'left', 'jquery', 'react'][p_partkey % 8 + 1] END AS name,
  CASE p_size % 9 WHEN 0 THEN '*' WHEN 1 THEN '>=1.0.0' ELSE '^1.2.3' END AS version, p_size % 4 = 0 AS dev, ['MIT', 'GPL-3.0', 'Apache-2.0', 'LGPL', NULL][p_size % 5 + 1] AS licence,
  CASE WHEN p_size % 7 <> 0 THEN p_size * 1000 + p_partkey END AS bytes FROM part)"""


def _reasons(s, d):
    """Issues as reasons of a check, one place in each source of documents."""
    return V(s, d, "issues").selectExpr("source as workspace", "doc_id as place", "element_at(array('doctor', 'review', 'release', 'session'), cast(doc_id % 4 + 1 as int)) as source", "rule_id as message", "severity", "concat('f', doc_id % 50) as file")


_REASONS = "reasons AS (SELECT source AS workspace, doc_id AS place, ['doctor', 'review', 'release', 'session'][doc_id % 4 + 1] AS source, rule_id AS message, severity, concat('f', doc_id % 50) AS file FROM issues)"


def _content(s, d):
    return T(s, d, "documents").selectExpr("cast(doc_id as string) as path", "if(doc_id % 2 = 0, replace(text, 'the ', 'the mark-line the-*, other -- known\n'), text) as content")


def _spoken(s, d):
    """The lines of documents as findings on their word `the`."""
    lines = _content(s, d).select("path", F.posexplode(F.split("content", "\n")).alias("k", "x"))
    return lines.where("contains(x, 'the ')").selectExpr("path", "k + 1 as line", "if(k % 2 = 0, 'the-word', 'a-word') as rule_id")


def _touches(s, d):
    return T(s, d, "events").selectExpr("user_id as session", "event_id as place", "concat('packages/', event_id % 7, '/', event_id % 5, '.ts') as path")


def _funcs(s, d):
    return V(s, d, "funcs").selectExpr("fn", "file", "bare")


def _edges(s, d):
    """The view of edges, written once for all that is drawn from it."""
    return sized(s, d, ("lineitem",), lambda: V(s, d, "edges"))


def _calls(s, d, edges=None):
    """Each part calls the name of the part that follows it in an order."""
    part = T(s, d, "part")
    return (V(s, d, "edges") if edges is None else edges).join(part.selectExpr("p_partkey as src", "p_brand as file"), "src").join(part.selectExpr("p_partkey as dst", "p_name as callee"), "dst").selectExpr("src as caller", "file", "callee")


def _brand_imports(s, d, edges=None):
    part = T(s, d, "part")
    rows = (V(s, d, "edges") if edges is None else edges).join(part.selectExpr("p_partkey as src", "p_brand as a"), "src").join(part.selectExpr("p_partkey as dst", "p_brand as b"), "dst")
    return rows.where("a <> b").selectExpr("a as src", "b as dst").distinct()


_CALLS = """calls AS (SELECT src AS caller, a.p_brand AS file, b.p_name AS callee FROM edges JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst),
 imports AS (SELECT DISTINCT a.p_brand AS src, b.p_brand AS dst FROM edges JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE a.p_brand <> b.p_brand)"""


def _parts(s, d):
    return T(s, d, "part").selectExpr("p_brand as path", "concat(p_brand, '.', p_name) as name", "p_partkey as line")


def _named(s, d):
    return T(s, d, "part").selectExpr("p_brand as path", "p_type as name")


def _leases(s, d):
    orders = T(s, d, "orders")
    return orders.selectExpr("o_orderkey as id", "o_custkey % 4 as agent", "concat('r', o_custkey % 5, if(o_custkey % 3 = 0, '', concat('/n', o_custkey))) as target", "cast(o_orderdate as timestamp) as claimed_at", "if(o_orderkey % 10 = 0, null, cast(o_orderdate as timestamp) + make_interval(0, 0, 0, 20)) as expires_at")


def _cards(s, d):
    return V(s, d, "issues").selectExpr("source as workspace", "doc_id as place", "rule_id as finding", "if(doc_id % 3 = 0, null, concat('f', doc_id % 20)) as file", "element_at(array('doctor', 'issue', 'hotspot', 'session', 'x'), cast(doc_id % 5 + 1 as int)) as source", "element_at(array('p0', 'p1', 'p2'), cast(doc_id % 3 + 1 as int)) as priority", "doc_id % 3 as sources", "doc_id % 4 as commands", "doc_id % 2 as files", "doc_id % 7 = 0 as has_doctor", "doc_id % 2 = 1 as has_test", "element_at(array('helpful', 'none', 'mixed', 'noisy'), cast(doc_id % 4 + 1 as int)) as trust")


def _daily(s, d):
    """What each kind of event touched on each day, as a snapshot."""
    return T(s, d, "events").groupBy(F.col("event_type").alias("key"), F.date_trunc("day", "ts").cast("timestamp").alias("at")).agg(F.sort_array(F.collect_set(F.concat((F.col("user_id") % 3).cast("string"), F.lit(":"), "user_id"))).alias("members"))


def _resolved(s, d):
    edges = _edges(s, d)
    return facts.resolve_calls(_calls(s, d, edges), _funcs(s, d), _brand_imports(s, d, edges))


def _semantic(s, d):
    edges = _edges(s, d)
    callers = T(s, d, "part").selectExpr("p_partkey as caller", "p_brand as path", "concat(p_brand, '.', p_name) as name", "p_partkey as line")
    calls = _calls(s, d, edges).join(callers, "caller").select("path", "name", "line", "callee")
    return facts.semantic_edges(_parts(s, d), _named(s, d), _named(s, d), _brand_imports(s, d, edges), calls)


QUERIES = {
    "name_similarity": lambda s, d: T(s, d, "part").selectExpr("p_partkey", "p_name", "p_type").select("p_partkey", scalar.round_half_up(scalar.name_similarity(F.col("p_name"), F.col("p_type")), 6).alias("similarity")),
    "tokens": lambda s, d: search.postings(T(s, d, "pages").selectExpr("page_id", "url as text"), key="page_id"),
    "semver_drift": lambda s, d: T(s, d, "part").selectExpr("p_partkey", "concat('v', p_size % 3, '.', p_size % 5, '.', p_partkey % 2) as a", "concat(p_size % 2, '.', p_size % 4, '.', p_partkey % 3) as b").select("p_partkey", scalar.semver_drift(F.col("a"), F.col("b")).alias("drift")),
    "dependency_risks": lambda s, d: supply.dependency_risks(_deps(s, d), _deps(s, d)),
    "licence_lines": lambda s, d: supply.licence_summary(_deps(s, d)),
    "size_summary": lambda s, d: supply.size_summary(_deps(s, d)),
    "frameworks": lambda s, d: supply.detect_frameworks(_deps(s, d)),
    "unused_dependencies": lambda s, d: supply.unused_dependencies(_deps(s, d), _deps(s, d).where("version = '*'").select("workspace", "name"), _deps(s, d).where("dev").selectExpr("workspace", "concat('run ', name, ' && x') as value").where("workspace < 'Brand#2'")),
    "breaking_lines": lambda s, d: supply.breaking_lines(T(s, d, "documents").selectExpr("doc_id", "if(doc_id % 3 = 0, replace(text, 'and', '# Breaking'), if(doc_id % 3 = 1, replace(text, 'der ', 'deprecated '), text)) as text"), "doc_id", "text"),
    "file_purpose": lambda s, d: V(s, d, "files").selectExpr("path", "concat(element_at(array('src/', 'pages/', 'lib/', ''), cast(doc_id % 4 + 1 as int)), element_at(array('my.test', 'index', 'Router', 'x', 'seed_it', 'model', 'apix'), cast(doc_id % 7 + 1 as int)), '.ts') as file").select("path", supply.infer_purpose(F.col("file")).alias("purpose")),
    "architecture_layers": lambda s, d: supply.architecture_layers(V(s, d, "files").selectExpr("dir as workspace", "path"), V(s, d, "files").selectExpr("dir as workspace", "upper(ext) as framework"), s.sql("SELECT * FROM VALUES ('Frontend', 'dir', 'en'), ('API', 'dir', 'de'), ('API', 'framework', 'FR') AS t(layer, kind, name)")),
    "command_category": lambda s, d: T(s, d, "events").select("event_id", *[c.alias(n) for c, n in zip(supply.command_category(F.concat("event_type", F.lit(" --"), F.col("user_id").cast("string"), F.lit("! X/y z")), COMMANDS), ("name", "category"))]),
    "inline_suppressed": lambda s, d: supply.suppress_inline(_spoken(s, d), _content(s, d), "mark-line"),
    "issues_by_file": lambda s, d: supply.issues_by_file(V(s, d, "files").selectExpr("concat('rule', doc_id % 9) as rule_id", "if(doc_id % 2 = 0, concat('see (', path, '), or ', path, 'x'), concat('in x', path, ' no')) as text"), V(s, d, "files"), V(s, d, "issues").selectExpr("concat(source, '/en/', doc_id, '.en') as path", "rule_id")),
    "audit_issues": lambda s, d: supply.audit_issues(T(s, d, "part").selectExpr("""concat('{"vulnerabilities": {"', p_name, '": {"severity": "', element_at(array('critical', 'high', 'moderate', 'low'), cast(p_size % 4 + 1 as int)), '", "fixAvailable": ', if(p_size % 3 = 0, 'false', '{"name": "x"}'), '}}}') as value""")),
    "lifecycle_scripts": lambda s, d: supply.lifecycle_scripts(T(s, d, "part").selectExpr("p_partkey as manifest", "element_at(array('prepare', 'install', 'test'), cast(p_partkey % 3 + 1 as int)) as name", "if(p_size % 2 = 0, 'tsc', 'node x.js') as value")),
    "payload_scan": lambda s, d: supply.payload_scan(T(s, d, "documents").selectExpr("concat(source, '/', doc_id, if(doc_id % 40 = 1, '/bad.js', '.js')) as path", "n_chars as size_bytes", "if(doc_id % 6 = 0, replace(replace(text, 'the', 'eval('), 'and', '_0xabcd'), text) as content").where("path is not null"), s.sql("SELECT * FROM VALUES ('licen', 'licence'), ('token', 'token') AS t(value, label)"), ("bad.js",), 500, 50_000),
    "file_profile": lambda s, d: planning.file_profile(V(s, d, "funcs").selectExpr("fn as path"), graph.coupling(V(s, d, "edges")), V(s, d, "funcs").selectExpr("fn as path", "bare as name", "cc"), T(s, d, "lineitem").where("l_returnflag = 'R'").selectExpr("l_partkey as path"), V(s, d, "coverage").withColumnRenamed("pct", "risk")),
    "top_risks": lambda s, d: planning.top_risks(_reasons(s, d), T(s, d, "nation").selectExpr("concat('f', n_nationkey) as path", "n_name as owner")),
    "session_conflicts": lambda s, d: planning.session_conflicts(_touches(s, d), _touches(s, d).selectExpr("path as src", "concat('packages/', (place + 1) % 7, '/', (place + 1) % 5, '.ts') as dst").distinct()),
    "likely_tests": lambda s, d: planning.likely_tests(T(s, d, "part").selectExpr("concat('tests/', replace(p_name, ' ', '_'), '.test.ts') as path").distinct(), T(s, d, "part").where("p_size = 1").selectExpr("concat('src/', split(p_name, ' ')[0], '.ts') as path")),
    "rank_candidates": lambda s, d: planning.rank_candidates(V(s, d, "queries").selectExpr("item_id as plan_id", "text"), T(s, d, "documents").selectExpr("concat('src/', regexp_extract(lower(text), '([a-z]{3,})', 1), doc_id % 3, '/', regexp_extract(lower(text), '([a-z]{3,}) ', 1), '.ts') as path", "doc_id % 20 as fan", "doc_id % 2 = 0 as at_risk").groupBy("path").agg(F.max("fan").alias("fan"), F.max("at_risk").alias("at_risk"))),
    "review_verdict": lambda s, d: planning.review_verdict(V(s, d, "ledger").groupBy("command").agg((F.max("event_id") % 100).alias("max_risk"), F.count_if(F.expr("event_id % 1999 = 0")).alias("new_cycles"), F.count_if(F.expr("event_id % 997 = 0")).alias("expanded_cycles"), F.count_if(F.expr("event_id % 499 = 0")).alias("risky_functions"), F.count_if(F.expr("event_id % 3001 = 0")).alias("new_flows")), "command"),
    "diff_flows": lambda s, d: planning.diff_flows(*[V(s, d, "snap").where(f"snapshot = '{x}'").groupBy((F.col("path") % 100).alias("source"), (F.col("fact") % 50).alias("sink")).agg(F.collect_set("path").alias("files")) for x in ("base", "head")], V(s, d, "work")).select("source", "sink", F.size("files").alias("files")),
    "graph_evidence": lambda s, d: planning.graph_evidence(V(s, d, "work").join(V(s, d, "funcs").selectExpr("fn as path", "file as workspace"), "path").select("workspace", "path"), V(s, d, "funcs").selectExpr("file as workspace", "fn as path", "bare as name")),
    "top_packages": lambda s, d: planning.top_packages(T(s, d, "part").selectExpr("p_brand as workspace", "p_partkey as path", "split(p_name, ' ')[0] as name")),
    "proof_requirements": lambda s, d: planning.proof_requirements(V(s, d, "files").selectExpr("dir as workspace", "path", "element_at(array('documentation', 'config', 'production', 'security'), cast(doc_id % 4 + 1 as int)) as surface"), V(s, d, "files").selectExpr("dir as workspace", "doc_id as place", "element_at(array('npm test', 'npm run lint', 'npm run test -- x', 'tsc'), cast(doc_id % 4 + 1 as int)) as command")),
    "caution_budget": lambda s, d: planning.caution_budget(_reasons(s, d)),
    "proof_debt": lambda s, d: planning.proof_debt(V(s, d, "ledger").selectExpr("command as workspace", "element_at(array('missing-proof', 'failed-proof', 'weak-proof'), cast(event_id % 3 + 1 as int)) as kind", "'warning' as severity", "cast(event_id % 11 as string) as message", "cast(null as string) as command", "concat('f', event_id % 5) as file")),
    "gate_status": lambda s, d: planning.gate_status(planning.proof_debt(V(s, d, "ledger").where("exit_code = 1").selectExpr("command as workspace", "element_at(array('missing-proof', 'failed-proof', 'scope-drift'), cast(event_id % 7 % 3 + 1 as int)) as kind", "'w' as severity", "'m' as message", "command", "'f' as file")), V(s, d, "ledger").select(F.col("command").alias("workspace"), F.lit("ready").alias("status")).distinct()),
    "trust_memory": lambda s, d: planning.trust_memory(T(s, d, "documents").selectExpr("doc_id as card_id", "text"), T(s, d, "benchmark").selectExpr("substring_index(text, ' ', 3) as note", "item_id % 2 = 0 as useful")),
    "rank_cards": lambda s, d: planning.rank_cards(_cards(s, d)),
    "classify_text": lambda s, d: T(s, d, "documents").select("doc_id", planning.classify_feedback(F.col("text")).alias("category")),
    "resolve_calls": _resolved,
    "semantic_nodes": lambda s, d: facts.semantic_nodes(_parts(s, d).select("path"), _parts(s, d), _named(s, d), _named(s, d)),
    "semantic_edges": _semantic,
    "rename_pairs": lambda s, d: facts.match_renames(*[T(s, d, "part").where(f"p_size % 2 = {k}").selectExpr("p_brand as path", "concat(p_name, p_partkey) as name") for k in (0, 1)]),
    "payload_paths": lambda s, d: facts.payload_paths(T(s, d, "documents").selectExpr("doc_id", "concat('{\"path\": \"', source, '/', lang, '.py\", \"files\": [\"a/', doc_id % 7, '\", \"/abs\", \"http://x/y\"], \"other\": \"no/no\"}') as payload"), "doc_id", "payload"),
    "claims_active": lambda s, d: state.claims_active(_leases(s, d), "1998-01-15 00:00:00").select("id", "agent", "target"),
    "snapshot_deltas": lambda s, d: state.snapshot_deltas(_daily(s, d)),
    "diff_issues": lambda s, d: changes.diff_issues(V(s, d, "issues").where("source <> 'src3'"), V(s, d, "issues").where("source <> 'src1'"), ("rule_id", "doc_id")),
    "collect_issues": lambda s, d: rules.collect_issues([V(s, d, "issues").where("category = 'security'"), V(s, d, "issues").where("category <> 'security'").drop("category")]),
    "package_scope": lambda s, d: rules.package_scope(V(s, d, "files"), V(s, d, "files").where("ext in ('en', 'de')").selectExpr("concat(dir, '/', ext) as prefix", "upper(concat(dir, '/', ext)) as name").distinct(), "SRC1/EN"),
    "impact_symbol": lambda s, d: graph.impact(V(s, d, "edges"), T(s, d, "part").where("p_name = 'red bolt'").selectExpr("p_partkey as path")),
    "fan_out": lambda s, d: flows.fan_out(V(s, d, "edges"), V(s, d, "funcs")),
    "edge_index": lambda s, d: flows.edge_index(flows.resolve_imports(V(s, d, "files").selectExpr("path", "concat(dir, '/', ext, '/', doc_id + 20) as spec"), V(s, d, "files"), ["", ".en", ".de", ".fr", ".es"]), V(s, d, "files").selectExpr("path", "ext as name")),
    "cross_repo_importers": lambda s, d: flows.cross_repo_importers(T(s, d, "part").selectExpr("p_brand as repo", "cast(p_partkey as string) as path", "concat('/', p_name, '.ts') as resolved"), T(s, d, "part").selectExpr("p_brand as repo", "concat('/', p_name, '.js') as path")),
    "dataflow_risks": lambda s, d: sized(s, d, ("lineitem",), lambda: flows.dataflow_risks(V(s, d, "edges"), *[T(s, d, "part").where(c).select(F.col("p_partkey").alias("node")) for c in ("p_size <= 2", "p_size >= 49")])),
    "guard_scopes": lambda s, d: state.guard_stream(V(s, d, "files").select((F.col("doc_id") % 3).alias("contract_id"), "path"), s.sql("SELECT * FROM VALUES (0, 'src1', 'allowed'), (0, 'src1/de', 'forbidden'), (1, 'src3', 'forbidden') AS t(contract_id, prefix, kind)")),
}


def _with(body: str, *views: str) -> str:
    """SQL that begins with further common table expressions after the views."""
    return (W("", *views).rstrip() + ", " if views else "WITH ") + body


_BY_KEY = {k: f"list_max(list_filter(range(0, least(length(p_name), length(p_type)) + 1), lambda k: {f}(p_name, k) = {f}(p_type, k)))" for k, f in (("prefix", "left"), ("suffix", "right"))}
_AFFIX = {k: v.replace("p_name", "a.name").replace("p_type", "b.name") for k, v in _BY_KEY.items()}
_LICENCES = "('GPL-3.0', 'LGPL')"
_CONTENT = "content AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 2 = 0 THEN replace(text, 'the ', 'the mark-line the-*, other -- known' || chr(10)) ELSE text END AS content FROM documents)"
_TOUCHES = """touches AS (SELECT user_id AS session, event_id AS place, concat('packages/', event_id % 7, '/', event_id % 5, '.ts') AS path FROM events),
 links AS (SELECT DISTINCT path AS src, concat('packages/', (place + 1) % 7, '/', (place + 1) % 5, '.ts') AS dst FROM touches),
 firsts AS (SELECT session, path, min(place) AS place, count(*) AS n FROM touches GROUP BY 1, 2),
 areas AS (SELECT *, lag(path) OVER (PARTITION BY session, split_part(path, '/', 2) ORDER BY place, path) AS before FROM firsts)"""
_NOTES = """notes AS (SELECT trim(regexp_replace(lower(array_to_string(string_split(text, ' ')[1:3], ' ')), '[^a-z0-9]+', ' ', 'g')) AS note, item_id % 2 = 0 AS useful FROM benchmark),
 wanted AS (SELECT note, count(*) FILTER (WHERE useful) AS up, count(*) FILTER (WHERE NOT useful) AS down, list_filter(list_distinct(string_split(note, ' ')), lambda w: length(w) >= 4 AND w NOT IN ('background', 'card', 'edit', 'false', 'finding', 'hotspot', 'noisy', 'positive', 'prevented', 'proof', 'signal', 'useful')) AS words FROM notes WHERE note <> '' GROUP BY note),
 cards AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents),
 sums AS (SELECT doc_id, coalesce(sum(up), 0) AS helpful, coalesce(sum(down), 0) AS noisy FROM cards c
   LEFT JOIN wanted w ON contains(c.t, w.note) OR (len(w.words) > 0 AND len(list_filter(w.words, lambda x: contains(c.t, x))) >= least(2, len(w.words))) GROUP BY doc_id)"""
_CARDS = """cards AS (SELECT source AS workspace, doc_id AS place, rule_id AS finding, CASE WHEN doc_id % 3 <> 0 THEN concat('f', doc_id % 20) END AS file, doc_id % 5 AS src, doc_id % 3 AS pri, doc_id % 4 AS com, doc_id % 2 AS odd, doc_id % 7 = 0 AS doc FROM issues),
 once AS (SELECT * FROM cards QUALIFY row_number() OVER (PARTITION BY workspace, coalesce(file, CAST(place AS VARCHAR)), finding ORDER BY place) = 1),
 strong AS (SELECT *, least(100, least(45, 25 * pri) + least(20, 8 * com) + 10 * odd + CASE WHEN src = 0 OR doc THEN 25 ELSE 0 END + 10 * odd) AS strength FROM once)"""
_SNAPS = """daily AS (SELECT event_type AS key, date_trunc('day', ts) AS "at", list_distinct(list(concat(user_id % 3, ':', user_id))) AS members FROM events GROUP BY 1, 2),
 steps AS (SELECT *, coalesce(lag(members) OVER (PARTITION BY key ORDER BY "at"), []) AS before FROM daily),
 moved AS (SELECT key, "at", unnest(list_filter(members, lambda m: NOT list_contains(before, m))) AS m, true AS came FROM steps UNION ALL SELECT key, "at", unnest(list_filter(before, lambda m: NOT list_contains(members, m))), false FROM steps)"""

_NEAR = REVIEWS["dataflow_bridges"].replace("seed, row_number()", "seed, hop, row_number()").replace("b.seed AS sink", "b.seed AS sink, a.hop = 1 AND b.hop = 1 AS near")
_REDACTED = reduce(lambda text, x: f"regexp_replace({text}, '{x[0].replace(chr(39), chr(39) * 2)}', '{x[1].replace('$1', chr(92) + '1')}', 'g')", scalar.REDACTIONS, "text")

ORACLE_SQL = {
    "redact_documents": f"SELECT doc_id, sha256({_REDACTED}) AS digest FROM documents",
    "dataflow_risks": f"""SELECT *, 'error' AS severity FROM (SELECT CASE depth WHEN 0 THEN 'direct' ELSE 'propagated' END AS kind, source, sink, NULL AS bridge, CASE WHEN depth <= 1 THEN 'high' ELSE 'medium' END AS confidence FROM ({REVIEWS['taint_flows']}) f
        UNION ALL SELECT 'bridge', source, sink, bridge, CASE WHEN near THEN 'high' ELSE 'medium' END FROM ({_NEAR}) b) risks""",
    "name_similarity": f"SELECT p_partkey, floor(greatest(1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)), greatest({_BY_KEY['prefix']}, {_BY_KEY['suffix']}) / greatest(length(p_name), length(p_type))) * 1000000 + 0.5) / 1000000 AS similarity FROM part",
    "tokens": f"SELECT term, page_id, count(*) AS tf FROM {terms('(SELECT page_id, url AS text FROM pages)', 'page_id')} z GROUP BY 1, 2",
    "semver_drift": "SELECT p_partkey, CASE WHEN p_size % 3 <> p_size % 2 THEN 'major' WHEN p_size % 5 <> p_size % 4 THEN 'minor' WHEN p_partkey % 2 <> p_partkey % 3 THEN 'patch' ELSE 'same' END AS drift FROM part",
    "dependency_risks": _with(_DEPS + f""" SELECT DISTINCT workspace, name, 'deprecated' AS rule, 'high' AS severity FROM deps WHERE name = 'moment' UNION SELECT workspace, name, 'heavy', 'medium' FROM deps WHERE NOT dev AND name IN ('lodash', 'jquery')
        UNION SELECT workspace, CASE WHEN count(DISTINCT name) > 100 THEN 'excessive-dependencies' ELSE 'many-dependencies' END, 'count', CASE WHEN count(DISTINCT name) > 100 THEN 'high' ELSE 'medium' END FROM deps WHERE NOT dev GROUP BY workspace HAVING count(DISTINCT name) > 50
        UNION SELECT workspace, name, 'wildcard', 'high' FROM deps WHERE NOT dev AND version <> '^1.2.3' UNION SELECT workspace, name, 'copyleft', 'high' FROM deps WHERE licence IN {_LICENCES}"""),
    "licence_lines": _with(_DEPS + f" SELECT coalesce(licence, 'UNKNOWN') AS licence, count(*) AS packages, coalesce(licence IN {_LICENCES}, false) AS copyleft FROM deps GROUP BY licence"),
    "size_summary": _with(_DEPS + """, firsts AS (SELECT * FROM deps WHERE bytes IS NOT NULL QUALIFY row_number() OVER (PARTITION BY workspace ORDER BY bytes DESC, name) <= 10)
        SELECT workspace, sum(bytes) AS total_bytes, count(*) FILTER (WHERE bytes IS NULL) AS missing, (SELECT string_agg(name, ',' ORDER BY bytes DESC, name) FROM firsts f WHERE f.workspace = d.workspace) AS largest FROM deps d GROUP BY workspace"""),
    "frameworks": _with(_DEPS + " SELECT DISTINCT workspace, f AS framework, c AS category FROM deps JOIN (VALUES ('vite', 'Vite', 'bundler'), ('express', 'Express', 'backend'), ('react', 'React', 'frontend')) t(n, f, c) ON n = name"),
    "unused_dependencies": _with(_DEPS + """ SELECT workspace, name, CASE WHEN bool_or(dev) THEN 'info' ELSE 'warning' END AS severity FROM deps d WHERE name NOT IN ('vite', '@types/node')
        AND NOT EXISTS (SELECT 1 FROM deps x WHERE x.workspace = d.workspace AND x.name = d.name AND (x.version = '*' OR (x.dev AND x.workspace < 'Brand#2'))) GROUP BY 1, 2"""),
    "breaking_lines": r"""SELECT doc_id, line, trim(x) AS excerpt FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS line FROM (
        SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN replace(text, 'and', '# Breaking') WHEN 1 THEN replace(text, 'der ', 'deprecated ') ELSE text END AS t FROM documents) a) b
        WHERE regexp_matches(x, '(?i)BREAKING\s+CHANGE|^#{1,6}.*breaking|\*\s*Breaking:|deprecat|removed\s+support|no\s+longer\s+supported')""",
    "file_purpose": W("SELECT path, ['Test file', 'Module entry point / barrel file', 'Route definitions', CASE doc_id % 4 WHEN 1 THEN 'UI component' WHEN 2 THEN 'Library / utility module' ELSE 'Source file' END, 'Database seed data', 'Data model / schema definition', 'API endpoint handler'][doc_id % 7 + 1] AS purpose FROM files", "files"),
    "architecture_layers": W("SELECT DISTINCT dir AS workspace, CASE ext WHEN 'en' THEN 'Frontend' ELSE 'API' END AS layer, CASE ext WHEN 'fr' THEN 'FR' ELSE ext END AS signal FROM files WHERE ext IN ('en', 'de', 'fr') AND dir IS NOT NULL", "files"),
    "command_category": "SELECT event_id, concat(event_type, ' --', user_id, ' x') AS name, CASE event_type WHEN 'click' THEN 'doctor' WHEN 'view' THEN 'review' WHEN 'error' THEN 'evidence' ELSE 'other' END AS category FROM events",
    "inline_suppressed": _with(_CONTENT + """, lines AS (SELECT doc_id, path, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM content)
        SELECT path, line, CASE WHEN line % 2 = 1 THEN 'the-word' ELSE 'a-word' END AS rule_id FROM lines WHERE contains(x, 'the ') AND NOT (contains(x, 'mark-line') AND line % 2 = 1)"""),
    "issues_by_file": W("SELECT path, concat('rule', doc_id % 9) AS rule_id FROM files WHERE doc_id % 2 = 0 AND path IS NOT NULL UNION SELECT f.path, rule_id FROM issues i JOIN files f ON f.path = concat(i.source, '/en/', i.doc_id, '.en')", "files", "issues"),
    "audit_issues": "SELECT concat('audit-', p_name) AS rule_id, ['error', 'error', 'warning', 'info'][p_size % 4 + 1] AS severity, 'security' AS category, p_size % 3 <> 0 AS fix_available FROM part",
    "lifecycle_scripts": "SELECT p_partkey AS manifest, CASE p_partkey % 3 WHEN 0 THEN 'prepare' ELSE 'install' END AS name, CASE WHEN p_size % 2 = 0 THEN 'tsc' ELSE 'node x.js' END AS value FROM part WHERE p_partkey % 3 = 1 OR (p_partkey % 3 = 0 AND p_size % 2 = 1)",
    "payload_scan": """SELECT path, finding, CASE finding WHEN 'obfuscated' THEN 'warning' ELSE 'error' END AS severity FROM (SELECT concat(source, '/', doc_id, CASE WHEN doc_id % 40 = 1 THEN '/bad.js' ELSE '.js' END) AS path,
        CASE WHEN doc_id % 40 = 1 THEN 'payload-file' WHEN n_chars NOT BETWEEN 500 AND 50000 THEN NULL WHEN contains(t, 'licen') OR contains(t, 'token') THEN 'indicator' WHEN regexp_matches(t, '(?i)_0x[a-f0-9]{4,}') AND regexp_matches(t, '\\beval\\s*\\(') THEN 'obfuscated' END AS finding
        FROM (SELECT *, CASE WHEN doc_id % 6 = 0 THEN replace(replace(text, 'the', 'eval('), 'and', '_0xabcd') ELSE text END AS t FROM documents) a WHERE source IS NOT NULL) b WHERE finding IS NOT NULL""".replace("\\\\", "\\"),
    "file_profile": _with("""deg AS (SELECT p_partkey AS path, (SELECT count(DISTINCT src) FROM edges WHERE dst = p_partkey) AS fan_in, (SELECT count(DISTINCT dst) FROM edges WHERE src = p_partkey) AS fan_out FROM part)
        SELECT p_partkey AS path, fan_in, fan_out, 1 AS functions, p_size AS cc, p_name AS worst_function, coalesce(n, 0) AS issues, pct AS risk FROM part JOIN deg ON deg.path = p_partkey LEFT JOIN coverage c ON c.path = p_partkey LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON l_partkey = p_partkey""", "edges", "coverage"),
    "top_risks": _with(_REASONS + """, firsts AS (SELECT * FROM reasons QUALIFY row_number() OVER (PARTITION BY workspace, source, message, file ORDER BY place, severity) = 1),
        ranked AS (SELECT *, CASE severity WHEN 'error' THEN 'p0' ELSE 'p1' END AS priority, row_number() OVER (PARTITION BY workspace ORDER BY severity <> 'error', place, source, message, file) AS rank FROM firsts)
        SELECT workspace, rank, priority, source, message, file, n_name AS owner FROM ranked LEFT JOIN nation ON file = concat('f', n_nationkey) WHERE rank <= 8""", "issues"),
    "session_conflicts": _with(_TOUCHES + """ SELECT session, 'same-file' AS kind, path AS file_a, NULL AS file_b FROM firsts WHERE n > 1
        UNION ALL SELECT session, 'same-workspace', before, path FROM (SELECT * FROM areas WHERE before IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session ORDER BY place, path) = 1) a
        UNION ALL SELECT session, 'import-related', src, dst FROM (SELECT f.session, f.place, src, dst FROM firsts f JOIN links ON dst = f.path AND src <> dst JOIN firsts g ON g.session = f.session AND g.path = src QUALIFY row_number() OVER (PARTITION BY f.session ORDER BY f.place, dst, src) = 1) b"""),
    "likely_tests": """WITH tests AS (SELECT DISTINCT replace(p_name, ' ', '_') AS base FROM part), names AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS name FROM part WHERE p_size = 1)
        SELECT concat('tests/', base, '.test.ts') AS test, max(CASE WHEN base = name THEN 100 ELSE 40 END) AS score FROM tests JOIN names ON base = name OR contains(concat('tests/', base, '.test.ts'), name) GROUP BY 1""",
    "rank_candidates": _with("""places AS (SELECT concat('src/', regexp_extract(lower(text), '([a-z]{3,})', 1), doc_id % 3, '/', regexp_extract(lower(text), '([a-z]{3,}) ', 1), '.ts') AS path, max(doc_id % 20) AS fan, bool_or(doc_id % 2 = 0) AS at_risk FROM documents GROUP BY 1),
        known AS (SELECT *, lower(path) AS p, lower(split_part(path, '/', -1)) AS f, regexp_replace(lower(split_part(path, '/', -1)), '\\.[^.]+$', '') AS s, list_distinct(regexp_extract_all(lower(path), '[a-z0-9]{2,}')) AS terms FROM places),
        asked AS (SELECT item_id, lower(text) AS plan, list_distinct(regexp_extract_all(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9]{2,}')) AS terms FROM queries),
        scored AS (SELECT item_id, path, fan, at_risk, CASE WHEN contains(plan, p) THEN 80 WHEN contains(plan, f) THEN 70 WHEN length(s) >= 3 AND contains(plan, s) OR length(s) < 3 AND list_contains(a.terms, s) THEN 60 ELSE 0 END
            + 12 * len(list_filter(list_intersect(a.terms, k.terms), lambda t: length(t) > 2)) AS score FROM asked a CROSS JOIN known k)
        SELECT item_id AS plan_id, path, score + CASE WHEN at_risk THEN 8 ELSE 0 END + least(10, fan) AS score FROM scored WHERE score > 0""", "queries"),
    "rename_pairs": "WITH RECURSIVE " + f"""pairs AS (SELECT a.path, a.name AS old, b.name AS new, greatest(1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)), greatest({_AFFIX['prefix']}, {_AFFIX['suffix']}) / greatest(length(a.name), length(b.name))) AS score
            FROM (SELECT DISTINCT p_brand AS path, concat(p_name, p_partkey) AS name FROM part WHERE p_size % 2 = 0) a JOIN (SELECT DISTINCT p_brand AS path, concat(p_name, p_partkey) AS name FROM part WHERE p_size % 2 = 1) b ON a.path = b.path),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, old, new) AS k FROM pairs WHERE score >= 0.5),
        walk AS (SELECT path, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS olds, CAST([] AS VARCHAR[]) AS news FROM (SELECT DISTINCT path FROM ranked) p
          UNION ALL SELECT w.path, r.k, CASE WHEN list_contains(olds, old) OR list_contains(news, new) THEN olds ELSE list_append(olds, old) END, CASE WHEN list_contains(olds, old) OR list_contains(news, new) THEN news ELSE list_append(news, new) END
          FROM walk w JOIN ranked r ON r.path = w.path AND r.k = w.k + 1),
        ends AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY path ORDER BY k DESC) = 1)
        SELECT path, unnest(olds) AS old, unnest(news) AS new FROM ends""",
    "review_verdict": W("""SELECT command, CASE WHEN worst >= 80 OR c > 0 OR f > 0 THEN 'block' WHEN worst >= 40 OR e > 0 OR r > 0 THEN 'review' ELSE 'ok' END AS verdict FROM (SELECT command, max(event_id) % 100 AS worst, count(*) FILTER (WHERE event_id % 1999 = 0) AS c,
        count(*) FILTER (WHERE event_id % 3001 = 0) AS f, count(*) FILTER (WHERE event_id % 997 = 0) AS e, count(*) FILTER (WHERE event_id % 499 = 0) AS r FROM ledger GROUP BY 1) t""", "ledger"),
    "diff_flows": _with("flows AS (SELECT snapshot, path % 100 AS source, fact % 50 AS sink, list(DISTINCT path) AS files FROM snap GROUP BY 1, 2, 3) SELECT h.source, h.sink, len(h.files) AS files FROM flows h WHERE snapshot = 'head' AND NOT EXISTS (SELECT 1 FROM flows b WHERE b.snapshot = 'base' AND b.source = h.source AND b.sink = h.sink) AND EXISTS (SELECT 1 FROM work WHERE list_contains(h.files, work.path))", "snap", "work"),
    "graph_evidence": W("SELECT p_brand AS workspace, n AS changed_files, n AS changed_functions, total AS total_functions FROM (SELECT p_brand, count(DISTINCT path) AS n FROM work JOIN part ON p_partkey = path GROUP BY 1) a JOIN (SELECT p_brand AS b, count(*) AS total FROM part GROUP BY 1) t ON b = p_brand", "work"),
    "top_packages": "SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY importers DESC, name) AS rank FROM (SELECT p_brand AS workspace, split_part(p_name, ' ', 1) AS name, count(*) AS importers FROM part GROUP BY 1, 2) t QUALIFY rank <= 5",
    "proof_requirements": _with("""known AS (SELECT dir, count(DISTINCT doc_id % 4) FILTER (WHERE doc_id % 2 = 0) AS tests, count(DISTINCT doc_id % 4) FILTER (WHERE doc_id % 2 = 1) AS others FROM files GROUP BY 1),
        kinds AS (SELECT dir, doc_id % 4 AS k, count(DISTINCT path) AS n FROM files GROUP BY 1, 2)
        SELECT kinds.dir AS workspace, ['documentation', 'config', 'production', 'security'][k + 1] AS surface, n AS files, CASE k WHEN 0 THEN 0 WHEN 2 THEN coalesce(tests, 0) + least(coalesce(others, 0), 1) ELSE coalesce(tests, 0) + coalesce(others, 0) END AS commands FROM kinds LEFT JOIN known ON known.dir = kinds.dir""", "files").replace("doc_id % 2 = 0", "doc_id % 4 IN (0, 2)").replace("doc_id % 2 = 1", "doc_id % 4 IN (1, 3)"),
    "caution_budget": _with(_REASONS + """, acts AS (SELECT *, CASE WHEN source IN ('release', 'session') THEN 'manual_signoff' ELSE 'fix_now' END AS action FROM reasons WHERE severity = 'warning')
        SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY action, CASE source WHEN 'doctor' THEN 0 WHEN 'review' THEN 1 WHEN 'release' THEN 2 ELSE 3 END, place, source, message, file) = 1 AS primary FROM acts""", "issues").replace("AS primary", 'AS "primary"'),
    "proof_debt": _with("""gaps AS (SELECT DISTINCT command, ['missing-proof', 'failed-proof', 'weak-proof'][event_id % 3 + 1] AS kind, event_id % 11 AS m, event_id % 5 AS f FROM ledger)
        SELECT c.command AS workspace, kinds.kind, (SELECT count(*) FROM gaps g WHERE g.command = c.command AND g.kind = kinds.kind) AS n FROM (SELECT DISTINCT command FROM gaps) c
        CROSS JOIN (VALUES ('missing-contract'), ('scope-drift'), ('missing-proof'), ('failed-proof'), ('stale-proof'), ('weak-proof'), ('recipe-gap')) kinds(kind)""", "ledger"),
    "gate_status": W("SELECT command AS workspace, CASE WHEN bool_or(exit_code = 1 AND event_id % 7 % 3 = 2) THEN 'drifted' WHEN bool_or(exit_code = 1 AND event_id % 7 % 3 = 1) THEN 'blocked' WHEN bool_or(exit_code = 1) THEN 'needs-proof' ELSE 'ready' END AS status FROM ledger GROUP BY 1", "ledger"),
    "trust_memory": _with(_NOTES + " SELECT doc_id AS card_id, helpful, noisy, CASE WHEN helpful > 0 AND noisy > 0 THEN 'mixed' WHEN helpful > 0 THEN 'helpful' WHEN noisy > 0 THEN 'noisy' ELSE 'none' END AS status FROM sums"),
    "rank_cards": _with(_CARDS + """ SELECT workspace, place, strength, CASE WHEN strength >= 75 THEN 'strong' WHEN strength >= 40 THEN 'moderate' ELSE 'thin' END AS level,
        row_number() OVER (PARTITION BY workspace ORDER BY pri, [0, 0, 2, 3, 4][src + 1], [0, 1, 3, 4][com + 1], place, finding, file) AS rank, [100, 80, 50][pri + 1] + CASE WHEN src < 2 THEN 20 ELSE 0 END + floor(strength / 5 + 0.5) + [12, 0, -8, -16][com + 1] AS score FROM strong""", "issues"),
    "classify_text": "SELECT doc_id, CASE " + " ".join("WHEN " + " AND ".join(f"regexp_matches(t, '{p.replace(chr(39), chr(39) * 2)}')" for p in patterns) + f" THEN '{k}'" for k, *patterns in planning.FEEDBACK) + " WHEN t IS NOT NULL THEN 'uncategorized' END AS category FROM (SELECT doc_id, lower(text) AS t FROM documents) x",
    "resolve_calls": _with(_CALLS + """, asked AS (SELECT DISTINCT file, callee FROM calls), here AS (SELECT file, callee, p_partkey AS fn FROM asked JOIN part ON p_brand = file AND p_name = callee),
        near AS (SELECT DISTINCT file, callee, p_partkey AS fn FROM asked JOIN imports ON src = file JOIN part ON p_brand = dst AND p_name = callee WHERE (file, callee) NOT IN (SELECT file, callee FROM here)),
        far AS (SELECT file, callee, p_partkey AS fn FROM asked JOIN part ON p_name = callee WHERE (file, callee) NOT IN (SELECT file, callee FROM here UNION ALL SELECT file, callee FROM near) AND (SELECT count(*) FROM part x WHERE x.p_name = callee) = 1)
        SELECT DISTINCT caller, fn FROM calls JOIN (SELECT * FROM here UNION ALL SELECT * FROM near UNION ALL SELECT * FROM far) r ON r.file = calls.file AND r.callee = calls.callee""", "edges"),
    "semantic_nodes": "SELECT DISTINCT concat('file:', p_brand) AS id, 'file' AS kind, p_brand AS label FROM part UNION SELECT concat('function:', p_brand, '#', p_brand, '.', p_name, '@', p_partkey), 'function', concat(p_brand, '.', p_name) FROM part UNION SELECT concat('package:', p_type), 'package', p_type FROM part UNION SELECT concat('symbol:', p_type), 'symbol', p_type FROM part",
    "semantic_edges": _with(_CALLS + """, fns AS (SELECT p_partkey, p_brand, p_name, concat('function:', p_brand, '#', p_brand, '.', p_name, '@', p_partkey) AS id FROM part)
        SELECT concat('file:', p_brand) AS start, id AS "end", 'defines' AS kind, concat(p_brand, '.', p_name) AS label FROM fns UNION SELECT concat('file:', p_brand), concat('package:', p_type), 'imports_package', p_type FROM part
        UNION SELECT concat('file:', p_brand), concat('symbol:', p_type), 'exports', p_type FROM part UNION SELECT concat('file:', src), concat('file:', dst), 'imports', dst FROM imports
        UNION SELECT a.id, b.id, 'calls', callee FROM calls JOIN fns a ON a.p_partkey = caller JOIN fns b ON b.p_name = callee WHERE a.id <> b.id""", "edges"),
    "payload_paths": "SELECT DISTINCT doc_id, path FROM (SELECT doc_id, concat(source, '/', lang, '.py') AS path FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL UNION ALL SELECT doc_id, concat('a/', doc_id % 7) FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL) t",
    "claims_active": "SELECT o_orderkey AS id, o_custkey % 4 AS agent, concat('r', o_custkey % 5, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE concat('/n', o_custkey) END) AS target FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-15 00:00:00' AND (o_orderkey % 10 = 0 OR o_orderdate + INTERVAL 20 DAY > TIMESTAMP '1998-01-15 00:00:00')",
    "snapshot_deltas": _with(_SNAPS + ' SELECT key, "at", split_part(m, chr(58), 1) AS dimension, count(*) FILTER (WHERE came) AS added, count(*) FILTER (WHERE NOT came) AS removed FROM moved GROUP BY 1, 2, 3'),
    "diff_issues": W("SELECT DISTINCT rule_id, doc_id, CASE source WHEN 'src3' THEN 'new' ELSE 'resolved' END AS status FROM issues WHERE source IN ('src1', 'src3')", "issues"),
    "collect_issues": W("SELECT doc_id, source, rule_id, severity, CASE category WHEN 'security' THEN category END AS category FROM issues", "issues"),
    "package_scope": W("SELECT path FROM files WHERE dir = 'src1' AND ext = 'en'", "files"),
    "impact_symbol": BASE["impact_file"].replace("p_size = 1", "p_name = 'red bolt'"),
    "fan_out": W("SELECT p_partkey AS fn, coalesce(n, 0) AS fan_out FROM part LEFT JOIN (SELECT src, count(DISTINCT b.p_name) AS n FROM edges JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE a.p_name <> b.p_name GROUP BY 1) t ON src = p_partkey", "edges"),
    "edge_index": f"""SELECT 'file' AS kind, path AS start, target AS "end" FROM ({REVIEWS['resolve_imports']}) r WHERE target IS NOT NULL UNION SELECT 'package', path, package FROM ({REVIEWS['resolve_imports']}) q WHERE package IS NOT NULL
        UNION SELECT 'symbol', concat(source, '/', lang, '/', CAST(doc_id AS VARCHAR), '.', lang), lang FROM documents WHERE lang IS NOT NULL""",
    "cross_repo_importers": """WITH found AS (SELECT DISTINCT b.p_brand AS owner, concat('/', b.p_name, '.js') AS target, a.p_brand AS repo, CAST(a.p_partkey AS VARCHAR) AS path FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand <> b.p_brand)
        SELECT *, (SELECT count(*) > 200 FROM found) AS truncated FROM found ORDER BY owner, target, repo, path LIMIT 200""",
    "guard_scopes": W("SELECT doc_id % 3 AS contract_id, path, CASE doc_id % 3 WHEN 0 THEN CASE WHEN starts_with(path, 'src1/de/') THEN 'forbidden' WHEN starts_with(path, 'src1/') THEN 'allowed' ELSE 'outside' END WHEN 1 THEN CASE WHEN starts_with(path, 'src3/') THEN 'forbidden' ELSE 'allowed' END ELSE 'allowed' END AS scope FROM files", "files"),
}
