"""SQL for the library's queries, written apart from the operators."""

from __future__ import annotations

from cartolode.functions import scalar
from cartolode.plans.bindings import with_views as W

_CHURN = "SELECT path, count(DISTINCT commit_hash) AS churn, count(DISTINCT author) AS authors, max(ts) AS last_change FROM {c} GROUP BY path"
_SHARES = """each AS (SELECT path, author, count(DISTINCT commit_hash) AS commits FROM commits GROUP BY path, author),
 shares AS (SELECT path, author, commits, floor(commits / sum(commits) OVER (PARTITION BY path) * 10000 + 0.5) / 10000 AS share,
   row_number() OVER (PARTITION BY path ORDER BY commits DESC, author) AS rank FROM each),
 churn AS (%s),
 bus AS (SELECT s.path, author AS primary_author, share, churn FROM shares s JOIN churn c ON s.path = c.path WHERE rank = 1 AND churn >= 3 AND share >= 0.8)""" % _CHURN.format(c="commits")
_RANKED = _SHARES + """,
 iss AS (SELECT l_partkey AS path, count(*) AS issues FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
 base AS (SELECT c.path, churn, authors, datediff('day', CAST(last_change AS DATE), CAST((SELECT max(ts) FROM commits) AS DATE)) AS days, p_size AS cc,
   coalesce(issues, 0) AS issues, coalesce(b.path IS NOT NULL, false) AS single, pct
   FROM churn c LEFT JOIN part ON p_partkey = c.path LEFT JOIN iss i ON i.path = c.path LEFT JOIN coverage v ON v.path = c.path LEFT JOIN (SELECT path FROM bus) b ON b.path = c.path),
 ranked AS (SELECT *, floor((log2(1 + churn) * 20 + log2(1 + cc) * 4 + log2(1 + churn) * log2(1 + cc) * 3 + log2(1 + authors) * 5 + issues * 12
   + CASE WHEN days <= 7 THEN 10 WHEN days <= 30 THEN 6 WHEN days <= 90 THEN 3 ELSE 0 END + CASE WHEN single THEN 15 ELSE 0 END
   + CASE WHEN pct IS NOT NULL THEN greatest(0, (100 - pct) / 100) * log2(1 + churn) * 4 ELSE 0 END) * 10 + 0.5) / 10 AS risk_score FROM base)"""
_MEMORY = """spine AS (SELECT run_ts, lead(run_ts) OVER (ORDER BY run_ts) AS next_run FROM (SELECT DISTINCT run_ts FROM runs) t),
 seen AS (SELECT rule_id, r.run_ts, next_run, lead(r.run_ts) OVER (PARTITION BY rule_id ORDER BY r.run_ts) AS again FROM runs r JOIN spine s ON r.run_ts = s.run_ts),
 memory AS (SELECT rule_id, min(run_ts) AS first_seen, max(run_ts) AS last_seen, count(*) AS run_count,
   count(*) FILTER (WHERE next_run IS NOT NULL AND (again IS NULL OR again <> next_run)) AS fixed_count FROM seen GROUP BY rule_id),
 aged AS (SELECT *, datediff('day', CAST(first_seen AS DATE), CAST((SELECT max(last_seen) FROM memory) AS DATE)) AS age_days FROM memory)"""
_PENALTY = "20 * count(*) FILTER (WHERE severity = 'error') + 10 * count(*) FILTER (WHERE severity = 'warning') + 3 * count(*) FILTER (WHERE severity = 'info')"
_HEALTH = f"""health AS (SELECT source, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings,
 count(*) FILTER (WHERE severity = 'info') AS infos, greatest(0, 100 - ({_PENALTY})) AS score FROM issues GROUP BY source)"""
_TOKENS = r"""(SELECT {k}, unnest(string_split_regex(trim(lower(replace(regexp_replace(regexp_replace(regexp_replace(
  array_to_string(regexp_extract_all(text, '[A-Za-z0-9_]+'), ' '), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([0-9]+)', ' \1 ', 'g'), '_', ' '))), '\s+')) AS t FROM {t})"""
_STOP = "(" + ", ".join(f"'{w}'" for w in (*scalar.STOP_WORDS, *scalar.SCRIPT_WORDS, *scalar.PYTHON_WORDS)) + ")"


def _terms(t: str, k: str) -> str:
    stem = "CASE WHEN length(t) <= 3 THEN t WHEN suffix(t, 'ing') THEN t[:-4] WHEN length(t) > 4 AND (suffix(t, 'ed') OR suffix(t, 'es')) THEN t[:-3] WHEN suffix(t, 's') AND NOT suffix(t, 'ss') THEN t[:-2] ELSE t END"
    return f"(SELECT {k}, s AS term FROM (SELECT {k}, {stem} AS s FROM {_TOKENS.format(t=t, k=k)} x) y WHERE length(s) >= 2 AND s NOT IN {_STOP})"


_INDEX = f"postings AS (SELECT term, doc_id, count(*) AS tf FROM {_terms('documents', 'doc_id')} z GROUP BY term, doc_id)"


def _bm25(b: str, name: str) -> str:
    return f"""{name} AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (
   SELECT item_id, p.doc_id, floor(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (1 - {b} + {b} * dl / mean_dl))) * 100 + 0.5) / 100 AS score
   FROM postings p JOIN terms q ON p.term = q.term JOIN freq f ON f.term = p.term JOIN lengths l ON l.doc_id = p.doc_id CROSS JOIN whole GROUP BY item_id, p.doc_id) s
   QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 30)"""


_SEARCH = f"""{_INDEX}, lengths AS (SELECT doc_id, sum(tf) AS dl FROM postings GROUP BY doc_id), whole AS (SELECT count(*) AS n, avg(dl) AS mean_dl FROM lengths),
 freq AS (SELECT term, count(*) AS df FROM postings GROUP BY term), terms AS (SELECT DISTINCT item_id, term FROM {_terms('queries', 'item_id')} q)"""
_DEP = """dep AS (SELECT DISTINCT a.stream AS stream_a, b.stream AS stream_b, src, dst FROM edges JOIN work a ON a.path = src JOIN work b ON b.path = dst
 WHERE a.stream <> b.stream AND NOT EXISTS (SELECT 1 FROM work w WHERE w.path = src AND w.stream = b.stream) AND NOT EXISTS (SELECT 1 FROM work w WHERE w.path = dst AND w.stream = a.stream)),
 same AS (SELECT a.path, a.stream AS stream_a, b.stream AS stream_b FROM work a JOIN work b ON a.path = b.path AND a.stream < b.stream)"""
_FINDINGS = "SELECT concat(rule_id, ':', CAST(doc_id AS STRING)) AS finding_id, CASE severity WHEN 'error' THEN 'p0' WHEN 'warning' THEN 'p1' ELSE 'p2' END AS priority, source, doc_id AS position FROM issues"


def _more(views: tuple, ctes: str, body: str) -> str:
    return W("", *views).rstrip() + ", " + ctes + " " + body


_C, _R = ("commits", "coverage"), ("runs",)
ORACLE_SQL = {
    "hotspots": _more(_C, _RANKED, "SELECT path, churn, authors, days, cc, issues, single, pct, risk_score FROM ranked WHERE risk_score > 0 ORDER BY risk_score DESC, path LIMIT 100"),
    "churn": W(_CHURN.format(c="commits"), "commits"),
    "churn_since": W(_CHURN.format(c="(SELECT * FROM commits WHERE ts >= CAST((SELECT max(ts) FROM commits) AS DATE) - INTERVAL 12 MONTH) q"), "commits"),
    "author_shares": _more(_C, _SHARES, "SELECT path, author, commits, share, rank FROM shares WHERE rank <= 5"),
    "bus_factor": _more(_C, _SHARES, "SELECT * FROM bus"),
    "risk_reasons": _more(_C, _RANKED, """SELECT path, concat_ws('|', 
      CASE WHEN churn >= 20 THEN 'high churn (' || churn || ' commits)' WHEN churn >= 8 THEN 'frequent changes (' || churn || ' commits)' WHEN churn = 1 THEN '1 commit' ELSE churn || ' commits' END,
      CASE WHEN cc >= 30 THEN 'high complexity (CC ' || cc || ')' WHEN cc >= 15 THEN 'moderate complexity (CC ' || cc || ')' END,
      CASE WHEN authors >= 2 THEN authors || ' contributors' END, CASE WHEN issues = 1 THEN '1 open issue' WHEN issues > 1 THEN issues || ' open issues' END,
      CASE WHEN days <= 7 THEN 'changed this week' END, CASE WHEN single THEN 'bus factor 1' END,
      CASE WHEN pct < 40 THEN 'low coverage (' || CAST(floor(pct + 0.5) AS BIGINT) || '%)' WHEN pct < 70 THEN 'moderate coverage (' || CAST(floor(pct + 0.5) AS BIGINT) || '%)' END) AS reasons FROM ranked WHERE risk_score > 0"""),
    "coverage_priority": _more(_C, _RANKED, "SELECT path, risk_score, pct, floor(risk_score * (0.3 + 0.7 * coalesce(greatest(0, (100 - pct) / 100), 1)) * 10 + 0.5) / 10 AS priority FROM ranked WHERE risk_score > 0"),
    "coverage_total": "SELECT CAST(sum(p_size * 2) AS BIGINT) AS found, CAST(sum(p_size) AS BIGINT) AS hit, floor(100 * sum(p_size) / sum(p_size * 2) * 10 + 0.5) / 10 AS pct FROM part",
    "rule_memory": _more(_R, _MEMORY, "SELECT * FROM memory"),
    "stable_rules": _more(_R, _MEMORY, "SELECT rule_id, run_count, age_days FROM aged WHERE run_count >= 3 AND fixed_count = 0 AND age_days >= 7"),
    "rule_confidence": _more(_R, _MEMORY, """SELECT rule_id, label, floor(CASE label WHEN 'high' THEN least(1, 0.6 + 0.4 * fixed_count / run_count) WHEN 'low' THEN greatest(0, 0.2 - 0.2 * least(1, run_count / 10)) ELSE 0.5 END * 10000 + 0.5) / 10000 AS score
      FROM (SELECT *, CASE WHEN fixed_count > 0 THEN 'high' WHEN run_count >= 3 AND age_days >= 7 THEN 'low' ELSE 'medium' END AS label FROM aged) t"""),
    "severity_drift": _more(_R, _MEMORY, "SELECT rule_id, CASE WHEN run_count >= 10 AND fixed_count = 0 THEN 'cry-wolf' WHEN run_count >= 5 AND fixed_count / run_count < 0.2 THEN 'noisy' ELSE 'stable' END AS drift FROM memory"),
    "latest_per_key": W("SELECT * FROM ledger QUALIFY row_number() OVER (PARTITION BY command ORDER BY completed_at DESC, event_id DESC) = 1", "ledger"),
    "sessions": """SELECT user_id, session, min(ts) AS began, max(ts) AS ended, count(*) AS events FROM (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (
      SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) a) b GROUP BY user_id, session""",
    "bounded_log": "SELECT event_id, ts, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age_rank FROM events QUALIFY age_rank <= 5",
    "cost_snapshot": W("""SELECT tool, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS total, CAST(floor(avg(tokens) + 0.5) AS BIGINT) AS mean, max(CASE WHEN pos = n // 2 THEN tokens END) AS median,
      max(CASE WHEN n >= 20 AND pos = least(n - 1, CAST(floor(n * 0.95) AS BIGINT)) THEN tokens END) AS p95 FROM (SELECT *, count(*) OVER (PARTITION BY tool) AS n, row_number() OVER (PARTITION BY tool ORDER BY tokens, event_id) - 1 AS pos FROM cost) t GROUP BY tool""", "cost"),
    "touches": "SELECT user_id, count(*) AS touches, max(ts) AS last_touch, arg_min(event_type, (ts, event_id)) AS first_source FROM events GROUP BY user_id",
    "signature_changes": "SELECT event_id, ts, user_id, event_type, before FROM (SELECT event_id, ts, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) t WHERE before IS NULL OR before <> event_type",
    "coupling": W("SELECT coalesce(a.path, b.path) AS path, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, floor(coalesce(fan_out, 0) / (coalesce(fan_in, 0) + coalesce(fan_out, 0)) * 100 + 0.5) / 100 AS instability FROM (SELECT dst AS path, count(DISTINCT src) AS fan_in FROM edges GROUP BY 1) a FULL JOIN (SELECT src AS path, count(DISTINCT dst) AS fan_out FROM edges GROUP BY 1) b ON a.path = b.path", "edges"),
    "impact_file": W("", "edges").replace("WITH ", "WITH RECURSIVE ").rstrip() + ", reach AS (SELECT p_partkey AS path, 0 AS distance FROM part WHERE p_size = 1 UNION SELECT src, distance + 1 FROM reach JOIN edges ON dst = path WHERE distance < 10) SELECT path, min(distance) AS distance FROM reach GROUP BY path",
    "cycles": W("", "edges").replace("WITH ", "WITH RECURSIVE ").rstrip() + ", reach AS (SELECT src AS a, dst AS b FROM edges UNION SELECT a, dst FROM reach JOIN edges ON src = b) SELECT x.a AS node, min(x.b) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a",
    "diff_rows": W("""SELECT coalesce(b.path, h.path) AS path, coalesce(b.fact, h.fact) AS fact, b.version AS old, h.version AS new, CASE WHEN b.version IS NULL THEN 'added' WHEN h.version IS NULL THEN 'removed' ELSE 'modified' END AS status
      FROM (SELECT * FROM snap WHERE snapshot = 'base') b FULL JOIN (SELECT * FROM snap WHERE snapshot = 'head') h ON b.path = h.path AND b.fact = h.fact WHERE b.version IS DISTINCT FROM h.version""", "snap"),
    "diff_facts": W("""SELECT path, count(*) FILTER (WHERE s = 'head') AS added, count(*) FILTER (WHERE s = 'base') AS removed FROM (SELECT path, fact, min(snapshot) AS s FROM snap GROUP BY path, fact HAVING count(DISTINCT snapshot) = 1) t GROUP BY path""", "snap"),
    "recurring_rules": W("SELECT fact, count(*) FILTER (WHERE snapshot = 'base') AS before, count(*) FILTER (WHERE snapshot = 'head') AS after FROM snap GROUP BY fact HAVING count(DISTINCT snapshot) = 2 ORDER BY count(*) DESC, fact LIMIT 5", "snap"),
    "collisions_same": _more(("work", "edges"), _DEP, "SELECT * FROM same"),
    "collisions_dep": _more(("work", "edges"), _DEP, "SELECT * FROM dep"),
    "integration_order": _more(("work", "edges"), _DEP, """SELECT stream, files, CAST(collisions AS BIGINT) AS collisions, CAST(risk AS BIGINT) AS risk, row_number() OVER (ORDER BY risk, files, stream) AS place FROM (
      SELECT w.stream, count(DISTINCT w.path) AS files, coalesce(max(n), 0) AS collisions, coalesce(max(r), 0) AS risk FROM work w LEFT JOIN (SELECT stream, count(*) AS n, sum(v) AS r FROM (
        SELECT stream_a AS stream, 2 AS v FROM same UNION ALL SELECT stream_b, 2 FROM same UNION ALL SELECT stream_a, 1 FROM dep UNION ALL SELECT stream_b, 1 FROM dep) u GROUP BY stream) k ON k.stream = w.stream GROUP BY w.stream) t"""),
    "merge_hot_files": W("SELECT path, count(DISTINCT stream) AS streams FROM work GROUP BY path HAVING count(DISTINCT stream) >= 2", "work"),
    "claims_contended": W("SELECT id, agent, target FROM claims x WHERE EXISTS (SELECT 1 FROM claims y WHERE x.agent <> y.agent AND (x.target = y.target OR starts_with(x.target, y.target || '/') OR starts_with(y.target, x.target || '/')))", "claims"),
    "scope_filter": W("SELECT doc_id, path FROM files WHERE starts_with(path, 'src1/') OR starts_with(path, 'src2/en/')", "files"),
    "rules_disabled": W("SELECT * FROM issues WHERE rule_id NOT LIKE 'licence%' AND rule_id <> 'long-number'", "issues"),
    "severity_override": W("SELECT doc_id, source, rule_id, CASE WHEN rule_id = 'licence-line' THEN 'warning' ELSE severity END AS severity, category FROM issues", "issues"),
    "redacted_paths": W("SELECT path, concat('file-', CAST(row_number() OVER (ORDER BY doc_id, path) AS STRING)) AS alias FROM files", "files"),
    "health_score": _more(("issues",), _HEALTH, "SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM health"),
    "score_breakdown": W(f"SELECT severity, category, count(*) AS issues, {_PENALTY} AS penalty FROM issues GROUP BY GROUPING SETS ((severity), (category), ())", "issues"),
    "ci_gate": _more(("issues",), _HEALTH, "SELECT source, score, errors AS severe, score >= 70 OR errors = 0 AS passed FROM health"),
    "dir_rollup": W("SELECT dir, CAST(sum(CASE WHEN own = dir THEN n ELSE 0 END) AS BIGINT) AS direct, CAST(sum(n) AS BIGINT) AS total FROM (SELECT dir AS top, dir || '/' || ext AS own, n, unnest([dir, dir || '/' || ext]) AS dir FROM (SELECT dir, ext, count(*) AS n FROM files GROUP BY 1, 2) a) b GROUP BY dir", "files"),
    "language_breakdown": W("SELECT ext, count(*) AS files, floor(100 * count(*) / sum(count(*)) OVER () * 10 + 0.5) / 10 AS percent FROM files GROUP BY ext", "files"),
    "large_groups": W("SELECT dir, count(*) AS files FROM files GROUP BY dir HAVING count(*) > 10", "files"),
    "longest_prefix": W("SELECT path, CASE WHEN ext IN ('en', 'de') THEN upper(dir || '/' || ext) ELSE 'root' END AS name FROM files", "files"),
    "content_lints": r"""SELECT doc_id, lines, concat_ws('|', CASE WHEN lines > 1000 THEN 'very-long' WHEN lines > 500 THEN 'long' END, CASE WHEN regexp_matches(text, 'console\.log|print\(') THEN 'debug-print' END,
      CASE WHEN regexp_matches(text, '\b(TODO|FIXME|HACK)\b') THEN 'task-marker' END) AS lints FROM (SELECT *, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INTEGER) AS lines FROM documents) t""",
    "changed_only": W("SELECT * FROM coverage WHERE path IN (SELECT path FROM work)", "coverage", "work"),
    "rank_findings": W(f"SELECT finding_id, priority, source, row_number() OVER (ORDER BY priority, source, finding_id) AS rank FROM ({_FINDINGS}) t QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY position) = 1", "issues"),
    "findings": W(_FINDINGS, "issues"),
    "unused_refs": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
    "dead_nodes": W("SELECT p_partkey AS path FROM part EXCEPT SELECT dst FROM edges", "edges"),
    "budget_prefix": "SELECT doc_id, source, tokens, used FROM (SELECT doc_id, source, tokens, CAST(sum(tokens) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM (SELECT doc_id, source, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM documents) a) b WHERE used <= 20000",
    "page": W("SELECT dir, doc_id, row_number() OVER (PARTITION BY dir ORDER BY doc_id) - 1 AS place FROM files QUALIFY place >= 5 AND place < 10", "files"),
    "feedback_summary": W("SELECT count(*) AS entries, count(*) FILTER (WHERE useful) AS useful, count(DISTINCT repo) AS repos, count(DISTINCT pr) AS prs, CAST(sum(minutes) AS BIGINT) AS minutes, floor(avg(minutes) * 100 + 0.5) / 100 AS mean_minutes, max(minutes) AS most_minutes FROM feedback", "feedback"),
    "repeat_use": W("SELECT repo, count(DISTINCT pr) AS prs FROM feedback GROUP BY repo HAVING count(DISTINCT pr) >= 2", "feedback"),
    "set_fingerprint": W("SELECT stream, sha256(string_agg(p, chr(10) ORDER BY p)) AS fingerprint FROM (SELECT DISTINCT stream, CAST(path AS STRING) AS p FROM work) t GROUP BY stream", "work"),
    "group_rollup": W("SELECT dir, ext, count(*) AS n FROM files GROUP BY ROLLUP (dir, ext)", "files"),
    "path_classes": W("SELECT path, CASE doc_id % 5 WHEN 0 THEN 'production' WHEN 1 THEN 'docs' WHEN 2 THEN 'test' WHEN 3 THEN 'generated' ELSE 'security' END AS class FROM files", "files"),
    "event_buckets": """SELECT event_id, CASE WHEN value < 1 THEN '<1s' WHEN value < 5 THEN '1-5s' WHEN value < 30 THEN '5-30s' WHEN value < 120 THEN '30s-2m' ELSE '2m+' END AS duration,
      CASE WHEN floor(value) <= 0 THEN '0' WHEN floor(value) = 1 THEN '1' WHEN floor(value) <= 5 THEN '2-5' WHEN floor(value) <= 20 THEN '6-20' WHEN floor(value) <= 100 THEN '21-100' ELSE '100+' END AS number,
      CASE WHEN value <= 0 THEN '0' WHEN value <= 5 THEN '1-5' WHEN value <= 10 THEN '6-10' WHEN value <= 20 THEN '10-20' ELSE '20+' END AS minutes FROM events""",
    "token_estimate": "SELECT doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM documents",
    "postings": f"WITH {_INDEX} SELECT * FROM postings",
    "bm25": _more(("queries",), _SEARCH + ", " + _bm25("0.75", "found"), "SELECT * FROM found"),
    "vector_topk": W("SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, floor(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) * 10000 + 0.5) / 10000 AS score FROM embeddings e JOIN vecq q ON e.vec_id <> q.vec_id) t QUALIFY rank <= 5", "vecq"),
    "bm25_boosted": _more(("queries", "files"), _SEARCH + f""", docs AS (SELECT doc_id, concat(lang, 'Anat ', split_part(text, ' ', 1)) AS text FROM documents), places AS (SELECT doc_id, path AS text FROM files),
      parts AS (SELECT item_id, p.doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / mean_dl)) AS part FROM postings p JOIN terms q ON p.term = q.term JOIN freq f ON f.term = p.term JOIN lengths l ON l.doc_id = p.doc_id CROSS JOIN whole
        UNION ALL SELECT item_id, doc_id, 2.0 FROM (SELECT DISTINCT doc_id, term FROM {_terms('docs', 'doc_id')} z) s JOIN terms q ON s.term = q.term
        UNION ALL SELECT item_id, doc_id, 0.5 FROM (SELECT DISTINCT doc_id, term FROM {_terms('places', 'doc_id')} z) s JOIN terms q ON s.term = q.term),
      scored AS (SELECT item_id, doc_id, floor(sum(part) * 100 + 0.5) / 100 AS score FROM parts GROUP BY 1, 2)""", "SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 30"),
    "postings_gated": "SELECT term, doc_id, count(*) AS tf FROM " + _terms("(SELECT * FROM documents WHERE lang IN ('en', 'fr') AND octet_length(encode(text)) <= 4000)", "doc_id") + " z GROUP BY term, doc_id",
    "rrf": _more(("queries",), _SEARCH + ", " + _bm25("0.75", "one") + ", " + _bm25("0.0", "two"), "SELECT item_id, doc_id, floor(sum(1.0 / (60 + rank)) * 1000000 + 0.5) / 1000000 AS score FROM (SELECT item_id, doc_id, rank FROM one UNION ALL SELECT item_id, doc_id, rank FROM two) t GROUP BY item_id, doc_id"),
    "symbol_search": "SELECT DISTINCT p_name AS symbol, CASE WHEN lower(p_name) = 're' THEN 0 WHEN starts_with(lower(p_name), 're') THEN 1 ELSE 2 END AS rank FROM part WHERE contains(lower(p_name), 're') ORDER BY rank, symbol LIMIT 30",
    "proof_status": W("""SELECT command, CASE WHEN completed_at IS NULL THEN 'missing' WHEN datediff('day', CAST(completed_at AS DATE), CAST((SELECT max(completed_at) FROM ledger) AS DATE)) > 0 THEN 'stale' WHEN exit_code <> 0 THEN 'failed' ELSE 'passed' END AS status
      FROM (SELECT command, max(completed_at) AS completed_at, arg_max(exit_code, (completed_at, event_id)) AS exit_code FROM ledger GROUP BY command UNION ALL SELECT 'never-run', NULL, NULL) t""", "ledger"),
    "preflight_verdict": W("SELECT source, CASE WHEN bool_or(severity = 'error') THEN 'block' WHEN bool_or(severity = 'warning') THEN 'caution' ELSE 'proceed' END AS verdict FROM issues GROUP BY source", "issues"),
    "run_outcome": W("SELECT command, count(*) FILTER (WHERE exit_code = 0) AS completed, count(*) FILTER (WHERE exit_code <> 0) AS failed, count(*) - count(DISTINCT CAST(completed_at AS DATE)) AS reruns FROM ledger GROUP BY command", "ledger"),
    "hotspot_delta": W("""SELECT path, CAST(before AS BIGINT) AS before, CAST(after AS BIGINT) AS after, CASE WHEN before IS NULL THEN 'appeared' WHEN after IS NULL THEN 'resolved' WHEN after > before THEN 'rose' ELSE 'fell' END AS moved
      FROM (SELECT path, sum(version) FILTER (WHERE snapshot = 'base') AS before, sum(version) FILTER (WHERE snapshot = 'head') AS after FROM snap GROUP BY path) t WHERE before IS DISTINCT FROM after""", "snap"),
    "cross_group_edges": W("SELECT a.p_brand AS src_group, b.p_brand AS dst_group, count(*) AS edges FROM edges JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE a.p_brand <> b.p_brand GROUP BY 1, 2", "edges"),
    "fan_in": W("SELECT b.p_brand AS file, count(DISTINCT a.p_brand) AS fan_in FROM edges JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE a.p_brand <> b.p_brand GROUP BY 1", "edges"),
    "public_closure": W("", "edges").replace("WITH ", "WITH RECURSIVE ").rstrip() + ", reach AS (SELECT p_partkey AS path, 0 AS distance FROM part WHERE p_size = 1 UNION SELECT dst, distance + 1 FROM reach JOIN edges ON src = path WHERE distance < 10) SELECT path, min(distance) AS distance FROM reach GROUP BY path",
}
