"""Evidence and policy: quality dimensions, proof ladders, coordination, ownership, import policy, symbols, scans, sink rows."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolode.functions.scalar import round_half_up, semver_drift
from cartolode.operators.rules import longest_prefix
from cartolode.sources.sarif import level, rule_name

#: Rules and other hand-written dimensions are broadcast up to this many rows.
RULE_ROWS = 10_000


def small_rules(rules: DataFrame) -> DataFrame:
    return F.broadcast(rules) if rules.limit(RULE_ROWS + 1).count() <= RULE_ROWS else rules


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), x))


#: Lines and complexity from which a hotspot without issues weighs on maintainability.
HOTSPOT_LINES, HOTSPOT_COMPLEXITY = 300, 15


def weighs(issues: Column, lines: Column, complexity: Column) -> Column:
    """Whether a hotspot lowers maintainability and not only stands beside it."""
    return (F.coalesce(issues, F.lit(0)) > 0) | (F.coalesce(lines, F.lit(0)) >= HOTSPOT_LINES) | (F.coalesce(complexity, F.lit(0)) >= HOTSPOT_COMPLEXITY)


def quality_dimensions(issues: DataFrame, hotspots: DataFrame, conflicts: DataFrame, by: str = "source") -> DataFrame:
    """(by, dimension, score, status): health, security, tests, maintainability and coordination of each group that has issues(by,
    rule_id, severity, category), hotspots(by, issues, lines, cc) or conflicts(by, severity).

    Security and tests weigh issues by severity; all other issues count against maintainability, as do hotspots with issues,
    many lines or high complexity, while others only make it worth a watch."""
    kind = F.when(F.col("category").isin("security", "supply-chain"), "security").when(F.col("rule_id").contains("test") | (F.col("category") == "testing"), "tests").otherwise("maintainability")
    tell = lambda df, part, severity=None, heavy=None: df.select(by, part.alias("part"), (F.lit(None).cast("string") if severity is None else severity).alias("severity"), (F.lit(False) if heavy is None else heavy).alias("heavy"))
    signals = tell(issues, kind, F.col("severity")).unionByName(tell(hotspots, F.lit("hotspot"), None, weighs(F.col("issues"), F.col("lines"), F.col("cc")))).unionByName(tell(conflicts, F.lit("conflict"), F.col("severity")))
    issue = F.col("part").isin("security", "tests", "maintainability")
    n = lambda which, severity=None: F.count_if(which if severity is None else which & (F.col("severity") == severity))
    part = lambda name: F.col("part") == name
    status = lambda which, watch: F.when(n(which, "error") > 0, "fail").when(watch > 0, "watch").otherwise("pass")
    weighed = lambda which, *points: clamp(100 - sum(p * n(which, s) for p, s in zip(points, ("error", "warning", "info"))))
    rows = {
        "health": (weighed(issue, 20, 10, 3), status(issue, n(issue, "warning"))),
        "security": (weighed(part("security"), 25, 12, 4), status(part("security"), n(part("security")))),
        "tests": (weighed(part("tests"), 25, 12, 4), status(part("tests"), n(part("tests")))),
        "maintainability": (clamp(100 - 10 * n(part("maintainability")) - 12 * n(F.col("heavy"))), status(part("maintainability"), n(part("maintainability") | part("hotspot")))),
        "coordination": (weighed(part("conflict"), 25, 10), status(part("conflict"), n(part("conflict")))),
    }
    each = F.array(*[F.struct(F.lit(k).alias("dimension"), v.cast("long").alias("score"), s.alias("status")) for k, (v, s) in rows.items()])
    return signals.groupBy(by).agg(each.alias("x")).select(by, F.inline("x"))


def proof_sufficiency(evidence: DataFrame) -> DataFrame:
    """evidence(requirement, surface, commands, matched, fresh_failed, fresh_passed, trusted, stale, touched, tested): its status."""
    c = F.col
    quiet = c("surface").isin("documentation", "generated")
    status = (
        F.when(c("fresh_failed") > 0, "failed")
        .when((c("commands") == 0) & quiet, "adequate").when(c("commands") == 0, "weak")
        .when(c("matched") == 0, "missing")
        .when((c("fresh_passed") == 0) & (c("stale") > 0), "stale").when(c("fresh_passed") == 0, "missing")
        .when(c("trusted") == 0, "weak")
        .when((c("surface") == "production") & (c("touched") > 0) & c("tested"), "strong")
        .when((c("surface") == "production") & (c("touched") == 0), "weak")
        .when((c("surface") != "production") & (c("touched") > 0), "strong")
        .otherwise("adequate")
    )
    return evidence.select("requirement", status.alias("status"))


def coordination(same: DataFrame, dep: DataFrame, contended: DataFrame) -> DataFrame:
    """One row: high and medium collisions, contended claims, and readiness."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    row = n(same, "high").crossJoin(n(dep, "medium")).crossJoin(n(contended, "contended"))
    return row.withColumn("readiness", F.when((F.col("high") > 0) | (F.col("contended") > 0), "conflicted").when(F.col("medium") > 0, "caution").otherwise("clear"))


def risk_delta(scores: DataFrame, penalty: Column, improvement: Column) -> DataFrame:
    """scores with baseline (score less penalty) and projected (with improvement), both within 0 and 100, and their difference."""
    rows = scores.withColumn("baseline", clamp(F.col("score") - penalty))
    rows = rows.withColumn("projected", clamp(F.col("baseline") + improvement))
    return rows.withColumn("delta", F.col("projected") - F.col("baseline"))


def release_scale(changed: DataFrame, by: str, most: int) -> DataFrame:
    rows = changed.groupBy(by).agg(F.countDistinct("path").alias("changed"))
    return rows.withColumn("release_scale", F.col("changed") > most)


def baseline_totals(runs: DataFrame) -> DataFrame:
    """Totals of runs(status, minutes) and the share that passed."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    rows = runs.agg(F.count("*").alias("runs"), n("passed"), n("failed"), F.coalesce(F.sum("minutes"), F.lit(0)).alias("minutes"))
    return rows.withColumn("completion", round_half_up(F.when(F.col("runs") > 0, F.col("passed") / F.col("runs")).otherwise(0.0), 2))


def metric_regressions(baseline: DataFrame, current: DataFrame, key: str, floors: tuple, ceilings: tuple) -> DataFrame:
    """Metrics that fell below the baseline though they may not, or rose, and keys that are gone: (key, metric, before, after)."""
    both = baseline.join(current.select(key, *[F.col(m).alias(f"{m}_now") for m in floors + ceilings], F.lit(True).alias("there")), key, "left")
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("long").alias("before"), F.col(f"{m}_now").cast("long").alias("after"), F.lit(m in floors).alias("floor")) for m in floors + ceilings]
    gone = both.where("there is null").select(key, F.lit("missing").alias("metric"), F.lit(None).cast("long").alias("before"), F.lit(None).cast("long").alias("after"))
    worse = both.where("there").select(key, F.inline(F.array(*rows))).where("if(floor, after < before, after > before)").drop("floor")
    return worse.unionByName(gone)


def accepted_hotspots(ranked_runs: DataFrame, least_runs: int = 5, least_days: int = 7, stale_days: int = 90) -> DataFrame:
    """Entries of ranked_runs(run_ts, path) that ranked in enough runs over enough days and lately: (path, run_count, age_days)."""
    newest = F.broadcast(ranked_runs.agg(F.max("run_ts").alias("newest")))
    rows = ranked_runs.groupBy("path").agg(F.min("run_ts").alias("first_seen"), F.max("run_ts").alias("last_seen"), F.countDistinct("run_ts").alias("run_count")).crossJoin(newest)
    rows = rows.withColumn("age_days", F.datediff("newest", "first_seen")).where(F.datediff("newest", "last_seen") <= stale_days)
    return rows.where((F.col("run_count") >= least_runs) & (F.col("age_days") >= least_days)).select("path", "run_count", "age_days")


def signal_counts(feedback: DataFrame, signals: tuple = ("useful", "noisy")) -> DataFrame:
    each = F.array(*[F.when(F.col(s), F.lit(s)) for s in signals])
    return feedback.select(F.explode(F.array_compact(each)).alias("signal")).groupBy("signal").agg(F.count("*").alias("n"))


def validation_rollup(feedback: DataFrame, target: int, least_useful: int = 3, least_minutes: float = 10) -> DataFrame:
    """One row over per-repository results: coverage against the target, useful answers, minutes, and whether all thresholds hold."""
    repo = feedback.groupBy("repo").agg(F.count("*").alias("n"), F.count_if("useful").alias("good"), F.coalesce(F.sum("minutes"), F.lit(0)).alias("m"))
    row = repo.agg(F.count("*").alias("repos"), F.sum("n").alias("responses"), F.sum("good").alias("useful"), F.sum("m").alias("minutes"), F.max("m").alias("most_minutes"))
    row = row.withColumn("mean_minutes", round_half_up(F.col("minutes") / F.col("responses"), 2))
    return row.withColumn("ready", (F.col("repos") >= target) & (F.col("useful") >= least_useful) & (F.col("mean_minutes") >= least_minutes))


def owners_of(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, owner) by the last of rules(rule_no, regex, owner) that fits; rules are written by hand and few."""
    return files.select("path").join(small_rules(rules), F.expr("path rlike regex")).groupBy("path").agg(F.max_by("owner", "rule_no").alias("owner"))


def owners_or_package(files: DataFrame, rules: DataFrame, packages: DataFrame) -> DataFrame:
    """owners_of, and for files without one the owner of the package(prefix, owner) with the longest prefix above them."""
    named = longest_prefix(files, packages.select(F.col("owner").alias("name"), "prefix"))
    known = packages.select("owner").distinct()
    fallback = named.join(known, named["name"] == known["owner"], "left_semi").select("path", F.col("name").alias("fallback"))
    rows = files.select("path").distinct().join(owners_of(files, rules), "path", "left").join(fallback, "path", "left")
    return rows.select("path", F.coalesce("owner", "fallback").alias("owner")).where("owner is not null")


def _fits(name: Column, patterns: Column) -> Column:
    """Whether one of patterns is `*`, the name itself, `folder/*` above it, or `*/end` of it."""
    return F.exists(
        F.coalesce(patterns, F.array().cast("array<string>")),
        lambda p: (p == "*") | (p == name) | (p.endswith("/*") & name.startswith(F.substring(p, F.lit(1), F.length(p) - 1)))
        | (p.startswith("*/") & name.endswith(F.substring(p, F.lit(2), F.length(p)))),
    )


def policy_violations(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Edges(from_package, to_package) that rules(from_package, allow, deny) forbid: not on the allow-list where there is
    one, else on the deny-list."""
    rows = edges.join(small_rules(rules), "from_package")
    listed = F.size(F.coalesce("allow", F.array().cast("array<string>"))) > 0
    denied = F.when(listed, ~_fits(F.col("to_package"), F.col("allow"))).otherwise(_fits(F.col("to_package"), F.col("deny")))
    return rows.where(denied).select("from_package", "to_package")


def suppress(issues: DataFrame, rules: DataFrame, path: str) -> DataFrame:
    """Issues that no row of rules(rule, regex) lets off."""
    return issues.join(small_rules(rules), (F.col("rule_id") == F.col("rule")) & F.expr(f"{path} rlike regex"), "left_anti")


def known_bad(deps: DataFrame, bad: DataFrame) -> DataFrame:
    """Dependencies(name, version) that bad(name, version) lists."""
    return deps.join(small_rules(bad.distinct()), ["name", "version"], "left_semi")


def match_recipes(files: DataFrame, recipes: DataFrame) -> DataFrame:
    """(path, recipe) for each of recipes(recipe, regex) whose pattern fits the path."""
    return files.select("path").distinct().join(small_rules(recipes), F.expr("path rlike regex")).select("path", "recipe")


def changed_after_proof(proofs: DataFrame, changes: DataFrame) -> DataFrame:
    """Files of a proof(proof, path, proved_at) that changes(path, ts) touched later: (proof, covered, changed, status)."""
    last = changes.groupBy("path").agg(F.max("ts").alias("last_change"))
    rows = proofs.join(last, "path", "left").groupBy("proof").agg(F.count("*").alias("covered"), F.count_if(F.col("last_change") > F.col("proved_at")).alias("changed"))
    return rows.withColumn("status", F.when(F.col("changed") > 0, "stale").otherwise("current"))


def guard_status(receipts: DataFrame) -> DataFrame:
    """receipts(contract_id, has_contract, forbidden, outside, changed_after, proof, sufficiency): blocked, drift, attention or clear."""
    c, weak = F.col, ("missing", "stale")
    status = (
        F.when(~c("has_contract"), "blocked").when(c("forbidden") + c("outside") + c("changed_after") > 0, "drift").when(c("proof") == "failed", "blocked")
        .when(c("proof").isin(*weak, "not-run", "partial") | c("sufficiency").isin(*weak, "weak", "failed"), "attention").otherwise("clear")
    )
    return receipts.select("contract_id", status.alias("status"))


def corpus_metrics(facts: DataFrame, by: str, metrics: tuple) -> DataFrame:
    """The sum of each metric by member of a corpus, and of all in the row where by is null."""
    return facts.rollup(by).agg(*[F.sum(m).alias(m) for m in metrics])


def shared_symbols(exports: DataFrame, top: int = 200) -> DataFrame:
    """Symbols that two repositories or more export, by how many."""
    rows = exports.groupBy("symbol").agg(F.countDistinct("repo").alias("repos")).where("repos >= 2")
    return rows.orderBy(F.desc("repos"), "symbol").limit(top)


def cross_repo_callers(definitions: DataFrame, calls: DataFrame) -> DataFrame:
    """(symbol, repo, caller) where another repository calls a symbol that repo defines."""
    a, b = definitions.select("symbol", "repo").distinct(), calls.select("symbol", F.col("repo").alias("caller")).distinct()
    return a.join(b, "symbol").where("repo <> caller")


def outdated(declared: DataFrame, installed: DataFrame, key: str = "name") -> DataFrame:
    rows = declared.select(key, "declared").join(installed.select(key, "installed"), key, "left")
    return rows.withColumn("drift", semver_drift(F.coalesce("declared", F.lit("")), F.coalesce("installed", F.lit(""))))


#: What a secret looks like, in the order in which patterns are tried.
SECRETS = (
    ("AWS Access Key", r"AKIA[0-9A-Z]{16}"),
    ("GitHub Token", r"gh[ps]_[A-Za-z0-9_]{36,}"),
    ("Stripe Secret Key", r"sk_(?:live|test)_[A-Za-z0-9]{24,}"),
    ("Stripe Webhook Secret", r"whsec_[A-Za-z0-9]{24,}"),
    ("Slack Token", r"xox[bpras]-[A-Za-z0-9-]+"),
    ("Private Key", r"-----BEGIN (?:RSA |EC |DSA )?PRIVATE KEY-----"),
    ("Generic Secret", r"""(?i)(?:password|secret|api_key|apikey|token|auth)\s*[=:]\s*['"]([^'"]{8,})['"]"""),
)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first pattern that each document fits; others are left out."""
    name = reduce(lambda rest, x: F.when(F.col(text_col).rlike(x[1]), x[0]).otherwise(rest), reversed(SECRETS), F.lit(None).cast("string"))
    return docs.select(id_col, name.alias("secret")).where("secret is not null")


def secret_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, line, secret): the first line of each document that fits a pattern, and the first pattern there whose value is no
    template and no key of a Firebase web application, which is public; lines that are comments as a whole do not count."""
    firebase = F.col(text_col).rlike(r"(?i)\bfirebase(?:app)?\b").alias("firebase")
    lines = docs.select(id_col, firebase, F.posexplode(F.split(F.col(text_col), r"\r?\n", -1)).alias("k", "x")).where(~F.trim("x").rlike(r"^(?://|#|\*|/\*|<!--)"))
    value = lambda p: F.when(F.regexp_extract("x", p, 1) != "", F.regexp_extract("x", p, 1)).otherwise(F.regexp_extract("x", p, 0)) if re.compile(p).groups else F.regexp_extract("x", p, 0)
    fits = lambda p: F.col("x").rlike(p) & ~F.contains(value(p), F.lit("{{")) & ~F.contains(value(p), F.lit("}}"))
    public = lambda s: F.col("firebase") & F.col("x").rlike(r"(?i)\bapiKey\b") & value(s[1]).startswith("AIza") if s[0] == "Generic Secret" else F.lit(False)
    name = reduce(lambda rest, s: F.when(fits(s[1]) & ~public(s), s[0]).otherwise(rest), reversed(SECRETS), F.lit(None).cast("string"))
    found = lines.select(id_col, (F.col("k") + 1).alias("line"), name.alias("secret")).where("secret is not null")
    return found.groupBy(id_col).agg(F.min(F.struct("line", "secret")).alias("x")).select(id_col, "x.line", "x.secret")


def excerpts(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text", width: int = 200) -> DataFrame:
    """(doc, line, excerpt): the first line that holds one of the terms, in any case, trimmed and cut to a width for display."""
    lines = F.transform(F.split(F.col(text_col), "\n", -1), lambda x, k: F.struct((k + 1).alias("line"), x.alias("x")))
    hit = lambda x: reduce(lambda a, b: a | b, [F.contains(F.lower(x["x"]), F.lit(t.lower())) for t in terms])
    rows = docs.select(id_col, F.get(F.filter(lines, hit), F.lit(0)).alias("h")).where("h is not null")
    return rows.select(id_col, F.col("h.line").alias("line"), F.substring(F.regexp_replace("h.x", r"^\s+|\s+$", ""), 1, width).alias("excerpt"))


def chunk_hash(docs: DataFrame, path: Column, text: Column, size: int = 4096) -> DataFrame:
    """Each text in chunks of so many characters, hashed with its path: (path, chunk, digest); an empty text is one chunk."""
    body = F.coalesce(text, F.lit(""))
    rows = docs.select(path.alias("path"), body.alias("t")).select("path", "t", F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.length("t") - 1, F.lit(0)) / size).cast("int"))).alias("chunk"))
    piece = F.substring("t", F.col("chunk") * size + 1, F.lit(size))
    return rows.select("path", "chunk", F.sha2(F.concat_ws("\n", "path", piece), 256).alias("digest"))


def sarif_results(issues: DataFrame, uri: Column) -> DataFrame:
    """Rows of a SARIF log: rule with its display name, level and location; `sources.sarif` writes whole documents."""
    return issues.select("rule_id", rule_name(F.col("rule_id")).alias("rule_name"), level(F.col("severity")).alias("level"), uri.alias("uri"), "category")


#: Names and endings of private keys, and endings of environment files that hold no values.
KEY_NAMES, KEY_ENDINGS, SAFE_ENVIRONMENTS = "id_rsa id_ed25519 id_ecdsa id_dsa".split(), ".pem .key .p12 .pfx".split(), ".example .sample .template".split()


def sensitive_files(files: DataFrame) -> DataFrame:
    """(path, rule_id, severity) of files(path) that are environment files or private keys by their name; one may be both."""
    name = F.substring_index("path", "/", -1)
    environment = name.rlike(r"^\.env(?:\..+)?$") & ~F.substring(name, 5, 1 << 20).isin(*SAFE_ENVIRONMENTS)
    secret = F.lower(name).isin(*KEY_NAMES) | F.lower(F.regexp_extract(name, r"(?<=[^.])(\.[^.]+)$", 1)).isin(*KEY_ENDINGS)
    rule = lambda when, rule_id, severity: F.when(when, F.struct(F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity")))
    return files.select("path", F.inline(F.array_compact(F.array(rule(environment, "env-file-committed", "warning"), rule(secret, "private-key-committed", "error")))))


def repository_inventory(files: DataFrame, exports: DataFrame) -> DataFrame:
    """(repo, files, exports) of files(repo, path) and exports(repo, path, symbol), 0 where a repository has none of either."""
    n = lambda df, columns, name: df.select("repo", *columns).distinct().groupBy("repo").agg(F.count("*").alias(name))
    return n(files, ["path"], "files").join(n(exports, ["path", "symbol"], "exports"), "repo", "full").fillna(0, ["files", "exports"])


def function_chunks(files: DataFrame, functions: DataFrame, size: int = 4096) -> DataFrame:
    """(path, key, digest): what is embedded of files(path, content), in pieces of at most so many characters: the lines of each of
    functions(path, name, line, end_line), under a head that names them, or the beginning of a file that has no functions."""
    start = F.greatest(F.lit(1), "line")
    ranges = functions.select("path", "name", start.alias("first"), F.greatest(start, "end_line").alias("last")).distinct()
    rows = files.select("path", F.coalesce("content", F.lit("")).alias("content")).join(ranges, "path", "left")
    lines = F.array_join(F.slice(F.split("content", "\n", -1), F.col("first"), F.col("last") - F.col("first") + 1), "\n")
    own = F.col("name").isNotNull()
    key = F.when(own, F.concat("path", F.lit("#"), "name")).otherwise(F.col("path"))
    head = F.when(own, F.concat(key, F.lit(" (lines "), F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string"), F.lit(")"))).otherwise(F.col("path"))
    text = F.concat(head, F.lit("\n\n"), F.substring(F.when(own, lines).otherwise(F.col("content")), 1, size))
    return rows.select("path", key.alias("key"), F.sha2(text, 256).alias("digest"))


def boundary_packages(targets: DataFrame, imports: DataFrame, owners: DataFrame) -> DataFrame:
    """(target, repo, package, owner, files): packages of imports(repo, package, path) of which a part is named as the last part of
    targets(target) is, without its ending, in any case; with the owner of the first of the importing files that owners(repo,
    path, owner) knows, else the repository, and how many files import it."""
    last = F.lower(F.regexp_replace(F.regexp_replace("target", r"^.*[/#]", ""), r"\.[^.]+$", ""))
    wanted = targets.select("target", last.alias("part")).where("part <> ''").distinct()
    named = imports.select("repo", "package").distinct().select("repo", "package", F.explode(F.array_distinct(F.split(F.lower("package"), "[/@._-]+"))).alias("part"))
    met = named.join(small_rules(wanted), "part").select("target", "repo", "package")
    used = imports.select("repo", "package", "path").distinct().join(owners.select("repo", "path", "owner"), ["repo", "path"], "left")
    sums = used.groupBy("repo", "package").agg(F.countDistinct("path").alias("files"), F.min(F.when(F.col("owner").isNotNull(), F.struct("path", "owner")))["owner"].alias("owner"))
    return met.join(sums, ["repo", "package"]).select("target", "repo", "package", F.coalesce("owner", "repo").alias("owner"), "files")
