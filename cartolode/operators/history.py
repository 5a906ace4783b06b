"""Churn, ownership, risk ranking, rule memory, sessions and other history. Keys name the columns that identify a file,
with the repository first where tables hold several."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolode.functions.scalar import round_half_up
from cartolode.sources.tables import save


def churn(commits: DataFrame, keys=("path",)) -> DataFrame:
    return commits.groupBy(*keys).agg(
        F.countDistinct("commit_hash").alias("churn"), F.countDistinct("author").alias("authors"), F.max("ts").alias("last_change")
    )


def since(commits: DataFrame, months: int = 12) -> DataFrame:
    """Commits of the last months before the newest one."""
    newest = commits.agg(F.max("ts").alias("newest"))
    return commits.join(F.broadcast(newest), F.col("ts") >= F.add_months("newest", -months)).drop("newest")


def author_shares(commits: DataFrame, keys=("path",), top: int = 5) -> DataFrame:
    """The top authors of each file by commits, with their share of all author commits of the file."""
    each = commits.groupBy(*keys, "author").agg(F.countDistinct("commit_hash").alias("commits"))
    file = Window.partitionBy(*keys)
    ranked = each.withColumns(
        {"share": round_half_up(F.col("commits") / F.sum("commits").over(file), 4), "rank": F.row_number().over(file.orderBy(F.desc("commits"), "author"))}
    )
    return ranked.where(F.col("rank") <= top)


def bus_factor(commits: DataFrame, keys=("path",), changed: DataFrame | None = None) -> DataFrame:
    """Files with three or more commits of which one author made four fifths; changed is the churn of commits if it is known."""
    first = author_shares(commits, keys, 1).where("share >= 0.8")
    found = first.join((churn(commits, keys) if changed is None else changed).where("churn >= 3"), list(keys))
    return found.select(*keys, F.col("author").alias("primary_author"), "share", "churn")


def risk_score(churn: Column, complexity: Column, authors: Column, days: Column, issues: Column, single: Column, coverage: Column) -> Column:
    change, size = F.log2(1 + churn), F.log2(1 + complexity)
    recent = F.when(days <= 7, 10).when(days <= 30, 6).when(days <= 90, 3).otherwise(0)
    uncovered = F.when(coverage.isNotNull() & (churn > 0), F.greatest(F.lit(0.0), (100 - coverage) / 100) * change * 4).otherwise(0.0)
    raw = change * 20 + size * 4 + change * size * 3 + F.log2(1 + authors) * 5 + issues * 12 + recent + F.when(single, 15).otherwise(0) + uncovered
    return F.when((churn == 0) & (issues == 0), 0.0).otherwise(round_half_up(raw, 1))


def hotspots(commits: DataFrame, complexity: DataFrame, issues: DataFrame, coverage: DataFrame, top: int | None = 100, keys=("path",)) -> DataFrame:
    """Files ranked by risk: change, complexity(path, cc), open issues(path, issues), single ownership, coverage(path, pct)."""
    # Everything below is told from a row a file, author and commit, written once.
    commits = save(commits.groupBy(*keys, "author", "commit_hash").agg(F.max("ts").alias("ts")), "commits")
    now = F.broadcast(commits.agg(F.max("ts").alias("now")))
    changed = save(churn(commits, keys), "churn")
    single = save(bus_factor(commits, keys, changed).select(*keys, F.lit(True).alias("single")), "single")
    on = list(keys)
    rows = changed.join(complexity, on, "left").join(issues, on, "left").join(coverage, on, "left").join(single, on, "left").crossJoin(now)
    rows = rows.withColumn("days", F.datediff("now", "last_change")).withColumn("issues", F.coalesce("issues", F.lit(0))).withColumn("single", F.coalesce("single", F.lit(False)))
    score = risk_score(*[F.col(c) for c in ("churn", "cc", "authors", "days", "issues", "single", "pct")])
    rows = rows.withColumn("risk_score", score).where("risk_score > 0").select(*keys, "churn", "authors", "days", "cc", "issues", "single", "pct", "risk_score")
    return rows if top is None else rows.orderBy(F.desc("risk_score"), *keys).limit(min(max(top, 1), 100))


def risk_reasons(ranked: DataFrame, keys=("path",)) -> DataFrame:
    """One text per file: why it ranks where it does."""
    churn, cc, pct = F.col("churn"), F.col("cc"), F.col("pct")
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    number = lambda c: c.cast("string")
    reasons = [
        F.when(churn >= 20, text("high churn (", number(churn), " commits)")).when(churn >= 8, text("frequent changes (", number(churn), " commits)")).when(churn == 1, "1 commit").when(churn > 1, text(number(churn), " commits")),
        F.when(cc >= 30, text("high complexity (CC ", number(cc), ")")).when(cc >= 15, text("moderate complexity (CC ", number(cc), ")")),
        F.when(F.col("authors") >= 2, text(number(F.col("authors")), " contributors")),
        F.when(F.col("issues") == 1, "1 open issue").when(F.col("issues") > 1, text(number(F.col("issues")), " open issues")),
        F.when(F.col("days") <= 7, "changed this week"),
        F.when(F.col("single"), "bus factor 1"),
        F.when((churn > 0) & (pct < 40), text("low coverage (", number(F.floor(pct + 0.5)), "%)")).when((churn > 0) & (pct < 70), text("moderate coverage (", number(F.floor(pct + 0.5)), "%)")),
    ]
    return ranked.select(*keys, F.array_join(F.array_compact(F.array(*reasons)), "|").alias("reasons"))


def coverage_priority(ranked: DataFrame, keys=("path",)) -> DataFrame:
    uncovered = F.coalesce(F.greatest(F.lit(0.0), (100 - F.col("pct")) / 100), F.lit(1.0))
    return ranked.select(*keys, "risk_score", "pct", round_half_up(F.col("risk_score") * (0.3 + 0.7 * uncovered), 1).alias("priority"))


def coverage_total(coverage: DataFrame) -> DataFrame:
    """coverage(lines_found, lines_hit) over all files."""
    found, hit = F.coalesce(F.sum("lines_found"), F.lit(0)), F.coalesce(F.sum("lines_hit"), F.lit(0))
    return coverage.agg(found.alias("found"), hit.alias("hit"), F.when(found > 0, round_half_up(100 * hit / found, 1)).otherwise(0.0).alias("pct"))


def rule_memory(runs: DataFrame, keys: tuple = (), suppressed: DataFrame | None = None) -> DataFrame:
    """Per rule of runs(run_ts, rule_id): first and last seen, in how many runs, and how often it was gone a run later.
    A rule of suppressed(keys, rule_id) is never fixed by being gone; the memory then says of each rule whether it is one."""
    spine = runs.select(*keys, "run_ts").distinct()
    order = Window.partitionBy(*keys).orderBy("run_ts")
    following = spine.withColumn("next_run", F.lead("run_ts").over(order))
    seen = runs.select(*keys, "rule_id", "run_ts").distinct().join(following, [*keys, "run_ts"])
    rule = Window.partitionBy(*keys, "rule_id").orderBy("run_ts")
    fixed = F.col("next_run").isNotNull() & (F.col("again").isNull() | (F.col("again") != F.col("next_run")))
    memory = (
        seen.withColumn("again", F.lead("run_ts").over(rule))
        .groupBy(*keys, "rule_id")
        .agg(F.min("run_ts").alias("first_seen"), F.max("run_ts").alias("last_seen"), F.count("*").alias("run_count"), F.count_if(fixed).alias("fixed_count"))
    )
    if suppressed is None:
        return memory
    marked = memory.join(suppressed.select(*keys, "rule_id", F.lit(True).alias("suppressed")).distinct(), [*keys, "rule_id"], "left").fillna(False, ["suppressed"])
    return marked.withColumn("fixed_count", F.when(F.col("suppressed"), 0).otherwise(F.col("fixed_count")).cast("long"))


def _age(memory: DataFrame) -> DataFrame:
    return memory.crossJoin(F.broadcast(memory.agg(F.max("last_seen").alias("as_of")))).withColumn("age_days", F.datediff("as_of", "first_seen")).drop("as_of")


def stable_rules(memory: DataFrame) -> DataFrame:
    """Rules of three runs and seven days or more that were never fixed; suppressed ones are not stable."""
    open_ = memory.where("not suppressed") if "suppressed" in memory.columns else memory
    return _age(open_).where("run_count >= 3 and fixed_count = 0 and age_days >= 7").select("rule_id", "run_count", "age_days")


def rule_confidence(memory: DataFrame) -> DataFrame:
    label = F.when(F.col("fixed_count") > 0, "high").when((F.col("run_count") >= 3) & (F.col("age_days") >= 7), "low").otherwise("medium")
    score = (
        F.when(F.col("label") == "high", F.least(F.lit(1.0), 0.6 + 0.4 * F.col("fixed_count") / F.col("run_count")))
        .when(F.col("label") == "low", F.greatest(F.lit(0.0), 0.2 - 0.2 * F.least(F.lit(1.0), F.col("run_count") / 10)))
        .otherwise(0.5)
    )
    return _age(memory).withColumn("label", label).select("rule_id", "label", round_half_up(score, 4).alias("score"))


def severity_drift(memory: DataFrame) -> DataFrame:
    drift = F.when((F.col("run_count") >= 10) & (F.col("fixed_count") == 0), "cry-wolf").when((F.col("run_count") >= 5) & (F.col("fixed_count") / F.col("run_count") < 0.2), "noisy").otherwise("stable")
    return memory.select("rule_id", drift.alias("drift"))


def latest_per_key(ledger: DataFrame, key: str = "command", order=("completed_at", "event_id")) -> DataFrame:
    """The newest record of each key; of equal times the later row."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return ledger.withColumn("rank", rank).where("rank = 1").drop("rank")


def sessionize(events: DataFrame, key: str = "user_id", hours: int = 1) -> DataFrame:
    """Sessions that end after so many hours without an event."""
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    gap = F.lag("ts").over(order)
    fresh = gap.isNull() | (F.col("ts") >= gap + F.expr(f"interval {hours} hours"))
    numbered = events.withColumn("fresh", fresh.cast("int")).withColumn("session", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.min("ts").alias("began"), F.max("ts").alias("ended"), F.count("*").alias("events"))


def bounded_log(events: DataFrame, key: str = "user_id", keep: int = 500) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id")))
    return events.withColumn("age_rank", rank).where(F.col("age_rank") <= keep)


def cost_snapshot(cost: DataFrame, key: str = "tool") -> DataFrame:
    """Per tool: calls, tokens, mean, median and, from 20 calls, the 95th percentile, each an observed value."""
    n, order = F.count("*").over(Window.partitionBy(key)), Window.partitionBy(key).orderBy("tokens", "event_id")
    ranked = cost.withColumns({"n": n, "at": F.row_number().over(order) - 1})
    pick = lambda at: F.max(F.when(F.col("at") == at, F.col("tokens")))
    p95 = F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95))
    return ranked.groupBy(key).agg(
        F.count("*").alias("calls"), F.sum("tokens").alias("total"), F.floor(F.avg("tokens") + 0.5).alias("mean"), pick(F.floor(F.col("n") / 2)).alias("median"),
        F.max(F.when((F.col("n") >= 20) & (F.col("at") == p95), F.col("tokens"))).alias("p95"),
    )


def top_spenders(cost: DataFrame, top: int = 10, key: str = "tool") -> DataFrame:
    """The tools of cost(key, tokens) that took most tokens, at most 50: (key, total, calls, mean, rank)."""
    rows = cost.groupBy(key).agg(F.sum("tokens").alias("total"), F.count("*").alias("calls"), F.floor(F.avg("tokens") + 0.5).alias("mean"))
    first = rows.orderBy(F.desc("total"), key).limit(min(max(top, 1), 50))
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), key)))


def touches(events: DataFrame, key: str = "user_id") -> DataFrame:
    return events.groupBy(key).agg(F.count("*").alias("touches"), F.max("ts").alias("last_touch"), F.min_by("event_type", F.struct("ts", "event_id")).alias("first_source"))


def signature_changes(events: DataFrame, key: str = "user_id", value: str = "event_type") -> DataFrame:
    """Rows where the value differs from the one before of the same key."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy("ts", "event_id"))
    return events.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col(value)))
