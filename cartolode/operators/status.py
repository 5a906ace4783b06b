"""Status ladders and verdicts over findings, proofs and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def proof_status(required: DataFrame, latest: DataFrame, as_of_days: int = 7) -> DataFrame:
    """required(command) against the latest record of each: missing, stale (older than the newest record by so many days), failed or passed."""
    newest = F.broadcast(latest.agg(F.max("completed_at").alias("newest")))
    rows = required.join(latest, "command", "left").crossJoin(newest)
    status = (
        F.when(F.col("completed_at").isNull(), "missing")
        .when(F.datediff("newest", "completed_at") > as_of_days, "stale")
        .when(F.col("exit_code") != 0, "failed")
        .otherwise("passed")
    )
    return rows.select("command", status.alias("status"))


def preflight_verdict(issues: DataFrame, by: str = "source") -> DataFrame:
    """Per group: block with an error, caution with a warning, else proceed."""
    worst = F.max(F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0))
    rows = issues.groupBy(by).agg(worst.alias("worst"))
    return rows.select(by, F.when(F.col("worst") == 2, "block").when(F.col("worst") == 1, "caution").otherwise("proceed").alias("verdict"))


def review_outcome(decisions: DataFrame, by: str = "run_id") -> DataFrame:
    """decisions(by, decision) to (by, decisions, approvals, change_requests, version_reviews); to review a version is to approve."""
    count = lambda *kinds: F.count_if(F.col("decision").isin(*kinds))
    return decisions.groupBy(by).agg(
        F.count("*").alias("decisions"), count("approve_next_slice", "review_version_candidate").alias("approvals"),
        count("request_changes").alias("change_requests"), count("review_version_candidate").alias("version_reviews"),
    )


def reruns(records: DataFrame, by: str, id_col: str = "id") -> DataFrame:
    """(by, reruns): how many records repeat an id that their group already has; records without one are no reruns."""
    return records.groupBy(by).agg((F.count(id_col) - F.countDistinct(id_col)).alias("reruns"))


def run_outcome(ledger: DataFrame, by: str = "command") -> DataFrame:
    """Per group: completed and failed records, and repeats of the same day."""
    return ledger.groupBy(by).agg(
        F.count_if(F.col("exit_code") == 0).alias("completed"),
        F.count_if(F.col("exit_code") != 0).alias("failed"),
        (F.count("*") - F.countDistinct(F.to_date("completed_at"))).alias("reruns"),
    )


def hotspot_delta(base: DataFrame, head: DataFrame, key: str = "path", score: str = "score") -> DataFrame:
    """How each entry moved between two rankings: appeared, resolved, rose or fell; those that stayed are left out."""
    both = base.select(key, F.col(score).alias("before")).join(head.select(key, F.col(score).alias("after")), key, "full")
    moved = (
        F.when(F.col("before").isNull(), "appeared").when(F.col("after").isNull(), "resolved")
        .when(F.col("after") > F.col("before"), "rose").when(F.col("after") < F.col("before"), "fell")
    )
    return both.withColumn("moved", moved).where("moved is not null")


def cross_group_edges(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges between nodes of different groups(path, name), counted by pair of groups; none where fewer than two groups
    besides `root` exist."""
    if groups.where("name <> 'root'").select("name").distinct().limit(2).count() < 2:
        edges = edges.limit(0)
    a, b = groups.select(F.col("path").alias("src"), F.col("name").alias("src_group")), groups.select(F.col("path").alias("dst"), F.col("name").alias("dst_group"))
    return edges.join(a, "src").join(b, "dst").where("src_group <> dst_group").groupBy("src_group", "dst_group").agg(F.count("*").alias("edges"))


def fan_in(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """Per file of functions(fn, file): distinct files other than itself that call into it."""
    a, b = functions.select(F.col("fn").alias("src"), F.col("file").alias("caller")), functions.select(F.col("fn").alias("dst"), "file")
    return edges.join(a, "src").join(b, "dst").where("caller <> file").groupBy("file").agg(F.countDistinct("caller").alias("fan_in"))
