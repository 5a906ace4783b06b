"""Queries of reports, look-ups and readiness over the test tables, with the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolode.operators import changes, evidence, flows, graph, history, rules, status, supply
from cartolode.plans.bindings import view as V
from cartolode.plans.bindings import with_views as W
from cartolode.plans.oracle import _MEMORY
from cartolode.plans.reviews import _owner_rules
from cartolode.sources.tables import table as T
from cartolode.streaming import state

EXTS = ".ts .tsx .py .json .md .zz".split()
DECISIONS = "approve_next_slice review_version_candidate request_changes other".split()


def _listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _index(s, d):
    """Brands as files that import each other, the first words of part names as packages, and types as symbols."""
    part = T(s, d, "part")
    brand = part.select("p_partkey", "p_brand")
    edges = V(s, d, "edges").join(brand.toDF("src", "path"), "src").join(brand.toDF("dst", "target"), "dst").select("path", "target")
    resolved = edges.withColumn("package", F.lit(None).cast("string")).unionByName(part.selectExpr("p_brand as path", "cast(null as string) as target", "split(p_name, ' ')[0] as package"))
    return flows.edge_index(resolved, part.selectExpr("p_brand as path", "p_type as name"))


def _asked(s, d, column):
    return T(s, d, "part").selectExpr(f"{column} as name").distinct()


def _ticks(s, d):
    """The events of a day as the log at that day's tick."""
    rows = T(s, d, "events").withColumn("tick", F.datediff(F.to_date("ts"), F.lit("1990-01-01").cast("date")).cast("long"))
    return rows.groupBy(F.col("event_type").alias("tool"), "tick").agg(F.count("*").alias("calls"), F.sum(F.floor("value")).cast("long").alias("tokens"))


def _paths(s, d):
    kind = "element_at(array('src/index.ts', 'tests/a.ts', 'lib/x.test.js', 'pkg/__init__.py', 'app/main.py', 'lib/b.ts', 'test_z.py'), cast(doc_id % 7 + 1 as int))"
    return T(s, d, "documents").selectExpr("doc_id", f"if(doc_id % 3 = 0, {kind}, concat('d', doc_id, '/', {kind})) as path")


_PATHS = """paths AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN k ELSE concat('d', doc_id, '/', k) END AS path FROM (SELECT doc_id, ['src/index.ts', 'tests/a.ts', 'lib/x.test.js', 'pkg/__init__.py', 'app/main.py', 'lib/b.ts', 'test_z.py'][doc_id % 7 + 1] AS k FROM documents) t)"""
QUERIES = {
    "language_report": lambda s, d: rules.language_report(T(s, d, "part").select(F.element_at(F.array(*map(F.lit, EXTS)), (F.col("p_size") % 6 + 1).cast("int")).alias("ext"))),
    "feedback_ready": lambda s, d: rules.feedback_ready(V(s, d, "feedback")),
    "page_cursor": lambda s, d: rules.page_after(T(s, d, "part").select("p_partkey"), ["p_partkey"], 20, (40, f"len:{T(s, d, 'part').count()}")),
    "page_cursor_reset": lambda s, d: rules.page_after(T(s, d, "part").select("p_partkey"), ["p_partkey"], 20, (40, "len:1")),
    "dead_files": lambda s, d: rules.dead_files(_paths(s, d), _paths(s, d).where("path like '%b.ts'").selectExpr("path as src", "replace(path, 'lib/b.ts', 'app/main.py') as dst"), _paths(s, d).where("path not like '%/main.py' or doc_id % 2 = 0")),
    "rule_memory_suppressed": lambda s, d: _suppressed(s, d),
    "stable_rules_suppressed": lambda s, d: history.stable_rules(_suppressed(s, d)),
    "top_spenders": lambda s, d: history.top_spenders(V(s, d, "cost"), 3),
    "review_outcome": lambda s, d: status.review_outcome(T(s, d, "events").select(F.col("user_id").alias("run_id"), F.element_at(F.array(*map(F.lit, DECISIONS)), (F.col("event_id") % 4 + 1).cast("int")).alias("decision"))),
    "reruns": lambda s, d: status.reruns(T(s, d, "events").selectExpr("user_id", "if(event_id % 5 = 0, null, concat(event_type, event_id % 11)) as id"), "user_id"),
    "graph_query_exports": lambda s, d: flows.look_up(_index(s, d), _asked(s, d, "p_brand"), "exports", 20),
    "graph_query_definitions": lambda s, d: flows.look_up(_index(s, d), _asked(s, d, "p_type"), "definitions"),
    "graph_query_package_importers": lambda s, d: flows.look_up(_index(s, d), _asked(s, d, "split(p_name, ' ')[0]"), "package_importers", 10),
    "impact_truncated": lambda s, d: graph.impact_report(V(s, d, "edges"), T(s, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("path")), 2),
    "score_delta": lambda s, d: changes.score_delta(V(s, d, "issues").where("severity <> 'error'"), V(s, d, "issues").where("severity <> 'warning'")),
    "missing_lockfiles": lambda s, d: supply.missing_lockfiles(T(s, d, "part").selectExpr("p_brand as repo", "p_name as name"), T(s, d, "part").selectExpr("p_brand as repo", "if(p_size = 7, 'yarn.lock', if(p_size = 8, 'a/yarn.lock', 'x')) as path")),
    "owner_fallback": lambda s, d: evidence.owners_or_package(V(s, d, "files"), _owner_rules(s).where("owner <> 'root'"), T(s, d, "documents").where("lang in ('en', 'de')").selectExpr("concat(source, '/', lang) as prefix").distinct().selectExpr("prefix", "upper(prefix) as owner")),
    "resolve_aliases": lambda s, d: flows.resolve_imports(V(s, d, "files").selectExpr("path", "concat(element_at(array('@/', 'lib/core/', 'lib/', 'x/'), cast(doc_id % 4 + 1 as int)), ext, '/', doc_id) as spec").where("path is not null"), V(s, d, "files"), [".en", ".de"], s.sql("SELECT * FROM VALUES ('@', 'src1'), ('lib', 'src2'), ('lib/core', 'src3') AS t(prefix, target)")),
    "cost_deltas": lambda s, d: state.cost_deltas(_ticks(s, d)),
    "large_utility_dirs": lambda s, d: rules.large_utility_dirs(T(s, d, "documents").selectExpr("concat(source, '/', element_at(array('utils', 'lib/x', 'core', 'shared/lib'), cast(doc_id % 4 + 1 as int))) as dir")),
    "secret_lines": lambda s, d: evidence.secret_lines(T(s, d, "documents").selectExpr("doc_id", "if(doc_id % 3 = 0, replace(text, 'token = \"', 'token = \"{{'), text) as text")),
}


def _suppressed(s, d):
    runs = V(s, d, "runs")
    return history.rule_memory(runs, suppressed=runs.where("rule_id like 'view:%'").select("rule_id"))


def _look(rows: str, limit: int) -> str:
    return f"""SELECT name, found, n > {limit} AS truncated FROM (SELECT *, count(*) OVER (PARTITION BY name) AS n, row_number() OVER (PARTITION BY name ORDER BY found) AS k
        FROM (SELECT DISTINCT {rows} FROM part) t) u WHERE k <= {limit}"""


_HARD = " ".join(
    f"WHEN regexp_matches(x, '{p}') AND NOT contains(CASE WHEN regexp_extract(x, '{p}', {1 if '([^' in p else 0}) <> '' THEN regexp_extract(x, '{p}', {1 if '([^' in p else 0}) ELSE regexp_extract(x, '{p}', 0) END, '{{{{') THEN '{n}'"
    for n, p in ((n, p.replace("'", "''")) for n, p in evidence.SECRETS)
)
ORACLE_SQL = {
    "language_report": f"""WITH known AS (SELECT unnest([{_listed(rules.EXTENSION_LANGUAGES)}]) AS e, unnest([{_listed(rules.EXTENSION_LANGUAGES.values())}]) AS language),
        used AS (SELECT language, e FROM (SELECT [{_listed(EXTS)}][p_size % 6 + 1] AS ext FROM part) p JOIN known ON e = ext),
        counted AS (SELECT language, count(*) AS files, array_to_string(list_sort(list(DISTINCT e)), ',') AS extensions FROM used GROUP BY 1)
        SELECT language, files, floor(1000 * files / sum(files) OVER () + 0.5) / 10 AS percent, extensions, language = (SELECT language FROM counted WHERE language NOT IN ({_listed(rules.DATA_LANGUAGES)}) ORDER BY files DESC, language LIMIT 1) AS is_primary FROM counted""",
    "feedback_ready": W("SELECT prs, n AS repeated_repos, prs >= 3 AND n >= 1 AS ready FROM (SELECT count(DISTINCT pr) AS prs FROM feedback) a, (SELECT count(*) AS n FROM (SELECT repo FROM feedback GROUP BY repo HAVING count(DISTINCT pr) >= 2) r) b", "feedback"),
    "page_cursor": "SELECT p_partkey, place, n AS total, CASE WHEN n > 60 THEN 60 END AS next_offset, concat('len:', n) AS checksum FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS place, count(*) OVER () AS n FROM part) t WHERE place > 40 AND place <= 60",
    "page_cursor_reset": "SELECT p_partkey, place, n AS total, CASE WHEN n > 20 THEN 20 END AS next_offset, concat('len:', n) AS checksum FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS place, count(*) OVER () AS n FROM part) t WHERE place <= 20",
    "dead_files": "WITH " + _PATHS + """ SELECT DISTINCT path FROM paths WHERE (path NOT LIKE '%/main.py' OR doc_id % 2 = 0) AND path NOT IN (SELECT replace(path, 'lib/b.ts', 'app/main.py') FROM paths WHERE path LIKE '%b.ts')
        AND NOT regexp_matches(path, '\\.test\\.|^tests/|/tests/|(^|/)test_[^/]+\\.py$|(^|/)(index|__init__)\\.[a-z]+$')""".replace("\\\\", "\\"),
    "rule_memory_suppressed": W("", "runs").rstrip() + ", " + _MEMORY + " SELECT rule_id, first_seen, last_seen, run_count, CASE WHEN rule_id LIKE 'view:%' THEN 0 ELSE fixed_count END AS fixed_count, rule_id LIKE 'view:%' AS suppressed FROM memory",
    "stable_rules_suppressed": W("", "runs").rstrip() + ", " + _MEMORY + """, unhidden AS (SELECT *, datediff('day', CAST(first_seen AS DATE), CAST((SELECT max(last_seen) FROM memory WHERE rule_id NOT LIKE 'view:%') AS DATE)) AS days FROM memory WHERE rule_id NOT LIKE 'view:%')
        SELECT rule_id, run_count, days AS age_days FROM unhidden WHERE run_count >= 3 AND fixed_count = 0 AND days >= 7""",
    "top_spenders": W("SELECT tool, CAST(sum(tokens) AS BIGINT) AS total, count(*) AS calls, CAST(floor(avg(tokens) + 0.5) AS BIGINT) AS mean, row_number() OVER (ORDER BY sum(tokens) DESC, tool) AS rank FROM cost GROUP BY tool QUALIFY rank <= 3", "cost"),
    "review_outcome": "SELECT user_id AS run_id, count(*) AS decisions, count(*) FILTER (WHERE event_id % 4 < 2) AS approvals, count(*) FILTER (WHERE event_id % 4 = 2) AS change_requests, count(*) FILTER (WHERE event_id % 4 = 1) AS version_reviews FROM events GROUP BY 1",
    "reruns": "SELECT user_id, count(*) FILTER (WHERE event_id % 5 <> 0) - count(DISTINCT CASE WHEN event_id % 5 <> 0 THEN concat(event_type, event_id % 11) END) AS reruns FROM events GROUP BY 1",
    "graph_query_exports": _look("p_brand AS name, p_type AS found", 20),
    "graph_query_definitions": _look("p_type AS name, p_brand AS found", 500),
    "graph_query_package_importers": _look("split_part(p_name, ' ', 1) AS name, p_brand AS found", 10),
    "impact_truncated": W("", "edges").replace("WITH ", "WITH RECURSIVE ").rstrip() + """, near AS (SELECT p_partkey AS path, 0 AS hop FROM part WHERE p_size = 1 UNION SELECT src, hop + 1 FROM near JOIN edges ON dst = path WHERE hop < 3),
        far AS (SELECT path, min(hop) AS distance FROM near GROUP BY 1) SELECT path, distance, (SELECT bool_or(distance > 2) FROM far) AS truncated FROM far WHERE distance <= 2""",
    "score_delta": W("""SELECT source, coalesce(b, 100) AS before, coalesce(a, 100) AS after, coalesce(a, 100) - coalesce(b, 100) AS delta FROM
        (SELECT source, greatest(0, 100 - (10 * count(*) FILTER (WHERE severity = 'warning') + 3 * count(*) FILTER (WHERE severity = 'info'))) AS b FROM issues WHERE severity <> 'error' GROUP BY 1) x FULL JOIN
        (SELECT source AS s, greatest(0, 100 - (20 * count(*) FILTER (WHERE severity = 'error') + 3 * count(*) FILTER (WHERE severity = 'info'))) AS a FROM issues WHERE severity <> 'warning' GROUP BY 1) y ON source = s""", "issues"),
    "missing_lockfiles": "SELECT DISTINCT p_brand AS repo, 'no-lockfile' AS rule, 'medium' AS severity FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 7)",
    "owner_fallback": W(r"SELECT * FROM (SELECT DISTINCT path, CASE WHEN regexp_matches(path, '^src1/de/.*7\.de$') THEN 'seven' WHEN contains(path, '/de/') THEN 'de' WHEN starts_with(path, 'src1/') THEN 'one' WHEN ext IN ('en', 'de') THEN upper(concat(dir, '/', ext)) END AS owner FROM files WHERE path IS NOT NULL) t WHERE owner IS NOT NULL", "files"),
    "resolve_aliases": W("""SELECT path, spec, CASE WHEN EXISTS (SELECT 1 FROM files g WHERE g.path = concat(tgt, '.en')) THEN concat(tgt, '.en') WHEN EXISTS (SELECT 1 FROM files g WHERE g.path = concat(tgt, '.de')) THEN concat(tgt, '.de') END AS target,
        CASE WHEN NOT EXISTS (SELECT 1 FROM files g WHERE g.path IN (concat(tgt, '.en'), concat(tgt, '.de'))) THEN split_part(spec, '/', 1) END AS package
        FROM (SELECT DISTINCT path, concat(['@/', 'lib/core/', 'lib/', 'x/'][doc_id % 4 + 1], ext, '/', doc_id) AS spec, concat(['src1/', 'src3/', 'src2/', 'x/'][doc_id % 4 + 1], ext, '/', doc_id) AS tgt FROM files WHERE path IS NOT NULL) t WHERE spec IS NOT NULL""", "files"),
    "cost_deltas": """WITH ticks AS (SELECT event_type AS tool, datediff('day', DATE '1990-01-01', CAST(ts AS DATE)) AS tick, count(*) AS calls, CAST(sum(floor(value)) AS BIGINT) AS tokens FROM events GROUP BY 1, 2),
        steps AS (SELECT *, CASE WHEN lag(tick) OVER w = tick - 1 THEN lag(calls) OVER w ELSE 0 END AS before FROM ticks WINDOW w AS (PARTITION BY tool ORDER BY tick))
        SELECT tool, tick, calls - before AS calls_added, greatest(0, tokens - CAST(floor(tokens / calls * before + 0.5) AS BIGINT)) AS tokens_added, calls, tokens FROM steps WHERE calls > before""",
    "large_utility_dirs": "SELECT * FROM (SELECT dir, CAST(sum(CASE WHEN dir LIKE '%shared/lib' THEN 2 WHEN dir LIKE '%/core' THEN 0 ELSE 1 END) AS BIGINT) AS files FROM (SELECT concat(source, '/', ['utils', 'lib/x', 'core', 'shared/lib'][doc_id % 4 + 1]) AS dir FROM documents WHERE source IS NOT NULL) t GROUP BY dir) u WHERE files > 10",
    "secret_lines": f"SELECT doc_id, line, secret FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS k FROM (SELECT doc_id, line, CASE {_HARD} END AS secret FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS line FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, 'token = \"', 'token = \"{{{{') ELSE text END AS t FROM documents) a) b WHERE NOT regexp_matches(trim(x), '^(//|#|\\*|/\\*|<!--)')) c WHERE secret IS NOT NULL) d WHERE k = 1",
}
