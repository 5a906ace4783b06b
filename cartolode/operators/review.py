"""Reviews of a change: metric, cycle, function and dependency differences, scope, trends, views of ranked rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolode.functions.scalar import ancestors
from cartolode.operators.changes import came_and_went
from cartolode.operators.ordered import numbered

#: A function is complex from HIGH on, and a rise of JUMP is a risk of its own.
HIGH, JUMP = 10, 5


def diff_metrics(base: DataFrame, head: DataFrame, key: str = "path", metrics: tuple = ("cc", "fan_in")) -> DataFrame:
    """Per file in both snapshots the change of each metric; files without any are left out."""
    both = base.select(key, *[F.col(m).alias(f"old_{m}") for m in metrics]).join(head.select(key, *metrics), key)
    deltas = both.select(key, *[(F.col(m) - F.col(f"old_{m}")).alias(f"{m}_delta") for m in metrics])
    return deltas.where(" or ".join(f"{m}_delta <> 0" for m in metrics))


def diff_cycles(base: DataFrame, head: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Cycles(node, component) of head that share no node with one of base (new) or are larger than what they share (expanded);
    with scope(node), those that go through one of its nodes."""
    if scope is not None:
        head = head.join(head.join(scope.select("node").distinct(), "node", "left_semi").select("component").distinct(), "component", "left_semi")
    sizes = head.groupBy("component").agg(F.count("*").alias("size"))
    shared = head.join(base.select("node", F.col("component").alias("other")), "node").groupBy("component", "other").agg(F.count("*").alias("n"))
    best = shared.groupBy("component").agg(F.max("n").alias("overlap"))
    rows = sizes.join(best, "component", "left").fillna(0, ["overlap"]).where("overlap < size")
    return rows.withColumn("classification", F.when(F.col("overlap") == 0, "new").otherwise("expanded"))


def risky_changes(base: DataFrame, head: DataFrame) -> DataFrame:
    """Functions(path, name, cc) of head that are complex and new, became complex, or jumped; names that are not unique
    on both sides are compared with nothing."""
    old = base.groupBy("path", "name").agg(F.count("*").alias("n_old"), F.min("cc").alias("old_cc"))
    now = head.groupBy("path", "name").agg(F.count("*").alias("n_new"))
    rows = head.join(now, ["path", "name"]).join(old, ["path", "name"], "left")
    paired = (F.col("n_old") == 1) & (F.col("n_new") == 1)
    reason = (
        F.when(F.col("n_old").isNull() & (F.col("cc") >= HIGH), "added")
        .when(paired & (F.col("old_cc") < HIGH) & (F.col("cc") >= HIGH), "crossed-threshold")
        .when(paired & (F.col("cc") - F.col("old_cc") >= JUMP), "jumped")
    )
    return rows.select("path", "name", "cc", F.when(paired, F.col("old_cc")).alias("base_cc"), reason.alias("reason")).where("reason is not null")


def review_files(changes: DataFrame, risk: DataFrame) -> DataFrame:
    """changes(path, status) with the risk of files that are still there."""
    rows = changes.select("path", "status").join(risk.select("path", "risk"), "path", "left")
    return rows.withColumn("risk", F.when(F.col("status") != "removed", F.col("risk")))


def review_totals(changes: DataFrame) -> DataFrame:
    """How many changes(tier, status) each tier holds: one row a tier, a column a status."""
    return changes.groupBy("tier").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "modified")])


def diff_dependencies(base: DataFrame, head: DataFrame, keys: tuple = ("manifest", "name")) -> DataFrame:
    """Dependencies(manifest, name, version, kind) added, removed, bumped (another version) or moved (another kind only)."""
    names = [F.col(c).alias(f"old_{c}") for c in ("version", "kind")]
    both = base.select(*keys, *names, F.lit(True).alias("in_base")).join(head.select(*keys, "version", "kind", F.lit(True).alias("in_head")), list(keys), "full")
    differ = lambda c: ~F.col(f"old_{c}").eqNullSafe(F.col(c))
    change = F.when(F.col("in_base").isNull(), "added").when(F.col("in_head").isNull(), "removed").when(differ("version"), "bumped").when(differ("kind"), "moved")
    return both.select(*keys, "old_version", "version", change.alias("change")).where("change is not null")


def scope_check(changed: DataFrame, contract: DataFrame) -> DataFrame:
    """changed(contract_id, path) against contract(contract_id, prefix, kind): forbidden below a forbidden folder or file,
    else allowed below an allowed one or where the contract allows nothing in particular, else outside."""
    rows = changed.select("contract_id", "path").distinct()
    hits = rows.withColumn("prefix", F.explode(ancestors(F.col("path")))).join(contract, ["contract_id", "prefix"])
    found = hits.groupBy("contract_id", "path").agg(F.max(F.col("kind") == "forbidden").alias("no"), F.max(F.col("kind") == "allowed").alias("yes"))
    limits = contract.where("kind = 'allowed'").select("contract_id", F.lit(True).alias("limited")).distinct()
    rows = rows.join(found, ["contract_id", "path"], "left").join(limits, "contract_id", "left")
    kind = F.when(F.col("no"), "forbidden").when(F.col("yes") | F.col("limited").isNull(), "allowed").otherwise("outside")
    return rows.select("contract_id", "path", kind.alias("scope"))


def scope_status(checked: DataFrame) -> DataFrame:
    """Per contract: drifted with a file forbidden or outside, else inside."""
    rows = checked.groupBy("contract_id").agg(F.count_if(F.col("scope") == "forbidden").alias("forbidden"), F.count_if(F.col("scope") == "outside").alias("outside"))
    return rows.withColumn("status", F.when(F.col("forbidden") + F.col("outside") > 0, "drifted").otherwise("inside"))


def trend(runs: DataFrame) -> DataFrame:
    """runs(run_ts, score), one row a run: the change of score and its direction, from the run before, and of the risk, which
    goes the other way."""
    placed = numbered(runs, ["run_ts"], "place")
    before = placed.select((F.col("place") + 1).alias("place"), F.col("score").alias("before"))
    rows = placed.join(before, "place", "left").withColumn("delta", F.col("score") - F.col("before")).select(*runs.columns, "delta")
    way = lambda c: F.when(c > 0, "up").when(c < 0, "down").when(c == 0, "flat")
    return rows.withColumns({"direction": way(F.col("delta")), "risk_delta": -F.col("delta"), "risk_direction": way(-F.col("delta"))})


def chunks(ranked: DataFrame, order: list, size: int = 20, by: tuple = ()) -> DataFrame:
    """Each group's ranked rows in chunks of fixed size, counted from 0."""
    return numbered(ranked, order, "chunk", by).withColumn("chunk", F.floor((F.col("chunk") - 1) / size))


def trend_counts(runs: DataFrame) -> DataFrame:
    """runs(run_ts, rule_id) to (run_ts, issues, new, resolved) a run: what it has, what the run before lacked, and what is gone
    since. The first run has null for the last two."""
    once = runs.select("run_ts", "rule_id").distinct()
    placed = numbered(once.select("run_ts").distinct(), ["run_ts"], "place")
    each = once.join(placed, "run_ts").select("place", "rule_id")
    now, before = each.withColumn("now", F.lit(1)), each.select((F.col("place") + 1).alias("place"), "rule_id", F.lit(1).alias("before"))
    both = now.join(before, ["place", "rule_id"], "full").groupBy("place").agg(F.count("now").alias("issues"), F.count_if(F.col("before").isNull()).alias("new"), F.count_if(F.col("now").isNull()).alias("resolved"))
    first = lambda c: F.when(F.col("place") > 1, F.col(c)).alias(c)
    return placed.join(both, "place").select("run_ts", "issues", first("new"), first("resolved"))


def coupling_ranked(coupled: DataFrame, view: str = "fan_in") -> DataFrame:
    """coupled(path, fan_in, fan_out, ...) with rank, the highest fan_in or fan_out first, ties by path."""
    rows = coupled.withColumn("_less", -F.col(view))
    return numbered(rows, ["_less", "path"], "rank").drop("_less")


def coupling_in_cycles(coupled: DataFrame, cyclic: DataFrame) -> DataFrame:
    return coupled.join(cyclic.select(F.col("node").alias("path")).distinct(), "path", "left_semi")


def read_targets(files: DataFrame, churn: DataFrame, keep: Column, top: int = 400, most_bytes: int = 512 * 1024) -> DataFrame:
    """The files(path, size_bytes) to read: those kept, by churn and size, with their lines estimated."""
    rows = files.where(keep & (F.col("size_bytes") <= most_bytes)).join(churn.select("path", "churn"), "path", "left").fillna(0, ["churn"])
    lines = F.greatest(F.lit(1), F.floor(F.col("size_bytes") / 40 + 0.5))
    return rows.select("path", "size_bytes", "churn", lines.alias("lines")).orderBy(F.desc("churn"), F.desc("size_bytes"), "path").limit(top)


def path_search(files: DataFrame, part: str, top: int = 50) -> DataFrame:
    return files.where(F.lower("path").contains(part.lower())).orderBy("path").limit(top)


def embed_plan(entries: DataFrame, chunks_: DataFrame, keys: tuple, digest: str) -> DataFrame:
    """What to do with each key: embed new and changed chunks, keep equal ones, drop entries without a chunk."""
    both = entries.select(*keys, F.col(digest).alias("old"), F.lit(1).alias("had")).join(chunks_.select(*keys, F.col(digest).alias("new"), F.lit(1).alias("has")), list(keys), "full")
    action = F.when(F.col("has").isNull(), "drop").when(F.col("had").isNull() | ~F.col("old").eqNullSafe(F.col("new")), "embed").otherwise("keep")
    return both.select(*keys, action.alias("action"))


def diff_contracts(base: DataFrame, head: DataFrame, public: DataFrame) -> DataFrame:
    """Exports(path, name) of public(path) files that came or went: (path, name, change)."""
    files = public.select("path").distinct()
    rows = came_and_went(*[side.join(files, "path", "left_semi") for side in (base, head)], ("path", "name"))
    change = F.array_compact(F.array(*[F.when(F.col(c), c) for c in ("added", "removed")]))
    return rows.select("path", "name", F.explode(change).alias("change"))


def diff_entrypoints(base: DataFrame, head: DataFrame) -> DataFrame:
    """Entry points(manifest, name, value) that came, went or changed: (manifest, name, before, after, change)."""
    keys = ["manifest", "name"]
    both = base.select(*keys, F.col("value").alias("before")).join(head.select(*keys, F.col("value").alias("after")), keys, "full").where("not before <=> after")
    return both.withColumn("change", F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed"))


def replay_status(proofs: DataFrame) -> DataFrame:
    """proofs(proof, scope, status, sufficiency) with replay: failed, stale, drifted, needs-proof or verified, the first that fits."""
    either = lambda value: (F.col("status") == value) | (F.col("sufficiency") == value)
    needs = (F.col("scope") == "missing-contract") | F.col("status").isin("missing", "partial") | F.col("sufficiency").isin("missing", "weak")
    ladder = F.when(either("failed"), "failed").when(either("stale"), "stale").when(F.col("scope") == "drifted", "drifted").when(needs, "needs-proof").otherwise("verified")
    return proofs.withColumn("replay", ladder)
