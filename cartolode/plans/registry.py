"""Queries of the library over the test tables; oracle.py holds the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolode.functions import scalar
from cartolode.operators import changes, graph, history, rules, search, status
from cartolode.plans import audits, extras, oracle, planned, reviews, sourced
from cartolode.plans.bindings import view
from cartolode.sources.tables import save, sized, table, wide

V, T = view, table


def _ranked(s, d, top=None):
    complexity = T(s, d, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("cc"))
    issues = T(s, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("path")).agg(F.count("*").alias("issues"))
    with wide(s, T(s, d, "lineitem").count()):
        return history.hotspots(V(s, d, "commits"), complexity, save(issues, "issues"), V(s, d, "coverage"), top)


def _memory(s, d):
    return history.rule_memory(V(s, d, "runs"))


def _index(s, d):
    """Stored once for the documents as they are; searches after that read no text."""
    return search.stored_index(s, f"{d}/documents.parquet", lambda: search.postings(T(s, d, "documents")))


def _fused(s, d):
    index, queries = _index(s, d), V(s, d, "queries")
    return search.rrf([search.bm25(index, queries), search.bm25(index, queries, b=0.0)], "item_id", "doc_id")


def _same_dep(s, d):
    work = V(s, d, "work")
    return work, changes.collisions_same(work), changes.collisions_dep(work, V(s, d, "edges"))


def _seeds(s, d):
    return T(s, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("path"))


def _overrides(s):
    return s.sql("SELECT 'licence-line' AS rule_id, 'warning' AS new_severity")


def _packages(s, d):
    return T(s, d, "documents").where("lang in ('en', 'de')").select(F.concat("source", F.lit("/"), "lang").alias("prefix")).distinct().withColumn("name", F.upper("prefix"))


QUERIES = {
    "hotspots": lambda s, d: _ranked(s, d, 100),
    "churn": lambda s, d: history.churn(V(s, d, "commits")),
    "churn_since": lambda s, d: history.churn(history.since(V(s, d, "commits"))),
    "author_shares": lambda s, d: sized(s, d, ("lineitem",), lambda: history.author_shares(V(s, d, "commits"))),
    "bus_factor": lambda s, d: sized(s, d, ("lineitem",), lambda: history.bus_factor(V(s, d, "commits"))),
    "risk_reasons": lambda s, d: history.risk_reasons(_ranked(s, d)),
    "coverage_priority": lambda s, d: history.coverage_priority(_ranked(s, d)),
    "coverage_total": lambda s, d: history.coverage_total(T(s, d, "part").select((F.col("p_size") * 2).alias("lines_found"), F.col("p_size").alias("lines_hit"))),
    "rule_memory": lambda s, d: _memory(s, d),
    "stable_rules": lambda s, d: history.stable_rules(_memory(s, d)),
    "rule_confidence": lambda s, d: history.rule_confidence(_memory(s, d)),
    "severity_drift": lambda s, d: history.severity_drift(_memory(s, d)),
    "latest_per_key": lambda s, d: history.latest_per_key(V(s, d, "ledger")),
    "sessions": lambda s, d: history.sessionize(T(s, d, "events"), hours=6),
    "bounded_log": lambda s, d: history.bounded_log(T(s, d, "events").select("event_id", "ts", "user_id"), keep=5),
    "cost_snapshot": lambda s, d: history.cost_snapshot(V(s, d, "cost")),
    "touches": lambda s, d: history.touches(T(s, d, "events")),
    "signature_changes": lambda s, d: history.signature_changes(T(s, d, "events").select("event_id", "ts", "user_id", "event_type")),
    "coupling": lambda s, d: graph.coupling(V(s, d, "edges")),
    "impact_file": lambda s, d: graph.impact(V(s, d, "edges"), _seeds(s, d)),
    "cycles": lambda s, d: graph.cycles(V(s, d, "edges")),
    "diff_rows": lambda s, d: changes.diff_rows(*changes.split(V(s, d, "snap")), ("path", "fact"), "version"),
    "diff_facts": lambda s, d: changes.diff_facts(*changes.split(V(s, d, "snap"))),
    "recurring_rules": lambda s, d: changes.recurring(*changes.split(V(s, d, "snap")), "fact"),
    "collisions_same": lambda s, d: changes.collisions_same(V(s, d, "work")),
    "collisions_dep": lambda s, d: _same_dep(s, d)[2],
    "integration_order": lambda s, d: changes.merge_risk(*_same_dep(s, d)),
    "merge_hot_files": lambda s, d: changes.merge_hot_files(V(s, d, "work")),
    "claims_contended": lambda s, d: changes.contended_claims(V(s, d, "claims")),
    "scope_filter": lambda s, d: rules.scope(V(s, d, "files").select("doc_id", "path"), ["src1", "src2/en"]),
    "rules_disabled": lambda s, d: rules.disable_rules(V(s, d, "issues"), ["licence*", "long-number"]),
    "severity_override": lambda s, d: rules.override_severity(V(s, d, "issues"), _overrides(s)),
    "redacted_paths": lambda s, d: rules.redact_paths(V(s, d, "files")),
    "health_score": lambda s, d: rules.health_score(V(s, d, "issues")),
    "score_breakdown": lambda s, d: rules.score_breakdown(V(s, d, "issues")),
    "ci_gate": lambda s, d: rules.ci_gate(rules.health_score(V(s, d, "issues")), V(s, d, "issues")),
    "dir_rollup": lambda s, d: rules.dir_rollup(V(s, d, "files")),
    "language_breakdown": lambda s, d: rules.languages(V(s, d, "files")),
    "large_groups": lambda s, d: rules.large_dirs(V(s, d, "files")),
    "longest_prefix": lambda s, d: rules.longest_prefix(V(s, d, "files"), _packages(s, d)),
    "content_lints": lambda s, d: rules.content_lints(T(s, d, "documents")),
    "changed_only": lambda s, d: rules.changed_only(V(s, d, "coverage"), V(s, d, "work")),
    "rank_findings": lambda s, d: rules.rank_findings(rules.to_findings(V(s, d, "issues"))),
    "findings": lambda s, d: rules.to_findings(V(s, d, "issues")),
    "unused_refs": lambda s, d: rules.unused(T(s, d, "customer").select(F.col("c_custkey").alias("k")), T(s, d, "orders").select(F.col("o_custkey").alias("k")), "k"),
    "dead_nodes": lambda s, d: rules.unused(V(s, d, "funcs").select(F.col("fn").alias("path")), V(s, d, "edges").select(F.col("dst").alias("path")), "path"),
    "budget_prefix": lambda s, d: rules.budget_prefix(T(s, d, "documents").select("doc_id", "source", scalar.estimate_tokens(F.col("text")).alias("tokens")), F.col("tokens"), ["doc_id"], 20_000, ("source",)),
    "page": lambda s, d: rules.page(V(s, d, "files").select("dir", "doc_id"), ["doc_id"], 1, 5, ("dir",)),
    "feedback_summary": lambda s, d: rules.feedback_summary(V(s, d, "feedback")),
    "repeat_use": lambda s, d: rules.repeat_use(V(s, d, "feedback")),
    "set_fingerprint": lambda s, d: rules.set_fingerprint(V(s, d, "work"), "stream", "path"),
    "group_rollup": lambda s, d: rules.group_rollup(V(s, d, "files"), "dir", "ext"),
    "path_classes": lambda s, d: V(s, d, "files").select("path", scalar.classify_path(F.concat(F.element_at(F.array(*map(F.lit, ("src/", "docs/", "tests/", "dist/", "a/auth/"))), (F.col("doc_id") % 5 + 1).cast("int")), "path")).alias("class")),
    "event_buckets": lambda s, d: T(s, d, "events").select("event_id", scalar.bucket_duration(F.col("value") * 1000).alias("duration"), scalar.bucket_count(F.floor("value")).alias("number"), scalar.bucket_minutes(F.col("value")).alias("minutes")),
    "token_estimate": lambda s, d: T(s, d, "documents").select("doc_id", scalar.estimate_tokens(F.col("text")).alias("tokens")),
    "redact_documents": lambda s, d: T(s, d, "documents").select("doc_id", F.sha2(scalar.redact_secrets(F.col("text")), 256).alias("digest")),
    "postings": lambda s, d: search.postings(T(s, d, "documents")),
    "bm25": lambda s, d: search.bm25(_index(s, d), V(s, d, "queries")),
    "vector_topk": lambda s, d: search.vector_topk(T(s, d, "embeddings"), V(s, d, "vecq")),
    "bm25_boosted": lambda s, d: search.bm25(_index(s, d), V(s, d, "queries"), symbols=T(s, d, "documents").selectExpr("doc_id", "concat(lang, 'Anat ', split(text, ' ')[0]) as text"), paths=V(s, d, "files").selectExpr("doc_id", "path as text")).select("item_id", "doc_id", "score", "rank"),
    "postings_gated": lambda s, d: search.postings(T(s, d, "documents").selectExpr("doc_id", "text", "concat('a/b.', lang) as path"), path="path", exts=(".en", ".fr"), most_bytes=4000),
    "rrf": _fused,
    "symbol_search": lambda s, d: search.symbol_search(T(s, d, "part").select(F.col("p_name").alias("symbol")).distinct(), "re"),
    "proof_status": lambda s, d: status.proof_status(V(s, d, "ledger").select("command").distinct().unionByName(s.sql("SELECT 'never-run' AS command")), history.latest_per_key(V(s, d, "ledger")), 0),
    "preflight_verdict": lambda s, d: status.preflight_verdict(V(s, d, "issues")),
    "run_outcome": lambda s, d: status.run_outcome(V(s, d, "ledger")),
    "hotspot_delta": lambda s, d: status.hotspot_delta(*[x.groupBy("path").agg(F.sum("version").alias("score")) for x in changes.split(V(s, d, "snap"))]),
    "cross_group_edges": lambda s, d: status.cross_group_edges(V(s, d, "edges"), V(s, d, "funcs").select(F.col("fn").alias("path"), F.col("file").alias("name"))),
    "fan_in": lambda s, d: status.fan_in(V(s, d, "edges"), V(s, d, "funcs")),
    "public_closure": lambda s, d: graph.impact(V(s, d, "edges").select(F.col("dst").alias("src"), F.col("src").alias("dst")), _seeds(s, d)),
}

QUERIES |= reviews.QUERIES | planned.QUERIES | extras.QUERIES | sourced.QUERIES | audits.QUERIES
ORACLE_SQL = oracle.ORACLE_SQL | reviews.ORACLE_SQL | planned.ORACLE_SQL | extras.ORACLE_SQL | sourced.ORACLE_SQL | audits.ORACLE_SQL
