"""Findings and their folds: suppression, severity, health, breakdowns, gates, roll-ups by directory and language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolode.functions.scalar import ancestors, parent_dir, round_half_up
from cartolode.operators.ordered import numbered, running


def scope(df: DataFrame, prefixes: list[str], path: str = "path") -> DataFrame:
    """Rows whose path is one of the prefixes or lies below it."""
    inside = F.lit(False)
    for p in prefixes:
        inside = inside | (F.col(path) == p) | F.col(path).startswith(p.rstrip("/") + "/")
    return df.where(inside)


def disable_rules(issues: DataFrame, disabled: list[str]) -> DataFrame:
    """Without the rules named, or whose name begins with what stands before a closing `*`."""
    off = F.lit(False)
    for d in disabled:
        off = off | (F.col("rule_id").startswith(d[:-1]) if d.endswith("*") else F.col("rule_id") == d)
    return issues.where(~off)


def override_severity(issues: DataFrame, overrides: DataFrame) -> DataFrame:
    """overrides(rule_id, new_severity) replace the severities that rules come with."""
    return issues.join(overrides, "rule_id", "left").withColumn("severity", F.coalesce("new_severity", "severity")).drop("new_severity")


def redact_paths(df: DataFrame, path: str = "path", order: str = "doc_id") -> DataFrame:
    """A number for each path, in order of first occurrence."""
    first = df.groupBy(path).agg(F.min(order).alias("first"))
    return numbered(first, ["first", path], "n").select(path, F.concat(F.lit("file-"), F.col("n").cast("string")).alias("alias"))


def _penalty() -> Column:
    return 20 * F.count_if(F.col("severity") == "error") + 10 * F.count_if(F.col("severity") == "warning") + 3 * F.count_if(F.col("severity") == "info")


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def health_score(issues: DataFrame, by: tuple = ("source",)) -> DataFrame:
    rows = issues.groupBy(*by).agg(
        *[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in ("error", "warning", "info")], F.greatest(F.lit(0), 100 - _penalty()).alias("score")
    )
    return rows.withColumn("grade", grade(F.col("score")))


def score_breakdown(issues: DataFrame) -> DataFrame:
    """Counts and penalties by severity, by category and over all."""
    sets = issues.groupingSets([["severity"], ["category"], []], "severity", "category")
    return sets.agg(F.count("*").alias("issues"), _penalty().alias("penalty"))


def ci_gate(scores: DataFrame, issues: DataFrame, threshold: int = 70, floor: str = "error", by: str = "source") -> DataFrame:
    """A group passes if its score reaches the threshold or it has no issue at or above the severity floor."""
    rank = F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    least = {"error": 2, "warning": 1, "info": 0}[floor]
    severe = issues.groupBy(by).agg(F.count_if(rank >= least).alias("severe"))
    return scores.join(severe, by, "left").select(by, "score", F.coalesce("severe", F.lit(0)).alias("severe"), ((F.col("score") >= threshold) | (F.coalesce("severe", F.lit(0)) == 0)).alias("passed"))


def dir_rollup(files: DataFrame, path: str = "path") -> DataFrame:
    """For every directory the files directly in it and those anywhere below."""
    here = parent_dir(F.col(path))
    rows = files.select(here.alias("parent"), F.explode(ancestors(here)).alias("dir")).where("dir <> ''")
    return rows.groupBy("dir").agg(F.count_if(F.col("parent") == F.col("dir")).alias("direct"), F.count("*").alias("total"))


def languages(files: DataFrame, ext: str = "ext") -> DataFrame:
    counts = files.groupBy(ext).agg(F.count("*").alias("files"))
    return counts.withColumn("percent", round_half_up(100 * F.col("files") / F.sum("files").over(Window.partitionBy()), 1))


#: The language of each extension, and languages of data and prose, which are no project's primary one.
EXTENSION_LANGUAGES = {
    ".ts": "TypeScript", ".tsx": "TypeScript", ".js": "JavaScript", ".jsx": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript",
    ".py": "Python", ".pyw": "Python", ".rb": "Ruby", ".go": "Go", ".rs": "Rust", ".java": "Java", ".kt": "Kotlin", ".kts": "Kotlin",
    ".swift": "Swift", ".cs": "C#", ".cpp": "C++", ".cc": "C++", ".cxx": "C++", ".c": "C", ".h": "C", ".hpp": "C++", ".php": "PHP",
    ".dart": "Dart", ".scala": "Scala", ".clj": "Clojure", ".ex": "Elixir", ".exs": "Elixir", ".erl": "Erlang", ".hs": "Haskell",
    ".lua": "Lua", ".r": "R", ".R": "R", ".pl": "Perl", ".pm": "Perl", ".sh": "Shell", ".bash": "Shell", ".zsh": "Shell", ".fish": "Shell",
    ".css": "CSS", ".scss": "SCSS", ".sass": "SASS", ".less": "Less", ".html": "HTML", ".htm": "HTML", ".vue": "Vue", ".svelte": "Svelte",
    ".sql": "SQL", ".graphql": "GraphQL", ".gql": "GraphQL", ".proto": "Protocol Buffers", ".json": "JSON", ".yaml": "YAML", ".yml": "YAML",
    ".toml": "TOML", ".xml": "XML", ".md": "Markdown", ".mdx": "MDX", ".txt": "Text",
}
DATA_LANGUAGES = ("JSON", "YAML", "TOML", "XML", "Markdown", "Text", "MDX")


def language_report(files: DataFrame, ext: str = "ext") -> DataFrame:
    """(language, files, percent, extensions, is_primary) of files whose extension is known; the primary language has the most
    files, the first by name of equals, data and prose left out."""
    known = F.create_map(*[F.lit(x) for pair in EXTENSION_LANGUAGES.items() for x in pair])
    rows = files.select(F.col(ext).alias("ext"), known[F.col(ext)].alias("language")).where("language is not null")
    by = rows.groupBy("language", "ext").agg(F.count("*").alias("n")).groupBy("language").agg(F.sum("n").alias("files"), F.array_join(F.sort_array(F.collect_list("ext")), ",").alias("extensions"))
    whole = by.agg(F.sum("files").alias("all"), F.min(F.when(~F.col("language").isin(*DATA_LANGUAGES), F.struct((-F.col("files")).alias("less"), "language"))).alias("first"))
    rows = by.crossJoin(F.broadcast(whole))
    return rows.select("language", "files", round_half_up(100 * F.col("files") / F.col("all"), 1).alias("percent"), "extensions", F.coalesce(F.col("language") == F.col("first.language"), F.lit(False)).alias("is_primary"))


def large_dirs(files: DataFrame, over: int = 10, group: str = "dir") -> DataFrame:
    return files.groupBy(group).agg(F.count("*").alias("files")).where(F.col("files") > over)


#: Folders that gather what belongs nowhere else.
UTILITY_DIRS = ("utils", "helpers", "lib", "shared")


def large_utility_dirs(files: DataFrame, over: int = 10, group: str = "dir") -> DataFrame:
    """Directories with more than so many files that are utility folders or lie in one; a file counts once for each such part."""
    parts = F.size(F.filter(F.split(group, "/"), lambda p: p.isin(*UTILITY_DIRS)))
    return files.groupBy(group).agg(F.sum(parts).alias("files")).where(F.col("files") > over)


def longest_prefix(files: DataFrame, packages: DataFrame) -> DataFrame:
    """The package(name, prefix) with the longest prefix above each file; `root` where none is."""
    up = files.select("path", F.explode(ancestors(F.col("path"))).alias("prefix"))
    best = up.join(packages, "prefix").groupBy("path").agg(F.max_by("name", F.length("prefix")).alias("name"))
    return files.select("path").join(best, "path", "left").select("path", F.coalesce("name", F.lit("root")).alias("name"))


def content_lints(docs: DataFrame, text: str = "text") -> DataFrame:
    lines = F.size(F.split(F.col(text), "\n"))
    found = F.array_compact(
        F.array(
            F.when(lines > 1000, "very-long").when(lines > 500, "long"),
            F.when(F.col(text).rlike(r"console\.log|print\("), "debug-print"),
            F.when(F.col(text).rlike(r"\b(TODO|FIXME|HACK)\b"), "task-marker"),
        )
    )
    return docs.select("doc_id", lines.alias("lines"), F.array_join(found, "|").alias("lints"))


def changed_only(df: DataFrame, changed: DataFrame, key: str = "path") -> DataFrame:
    return df.join(changed.select(key).distinct(), key, "left_semi")


def rank_findings(findings: DataFrame) -> DataFrame:
    """First of each id(finding_id, priority, source, position), then ranked by priority, source and id."""
    first = F.row_number().over(Window.partitionBy("finding_id").orderBy("position"))
    once = findings.withColumn("nth", first).where("nth = 1").drop("nth", "position")
    return numbered(once, ["priority", "source", "finding_id"], "rank")


def to_findings(issues: DataFrame) -> DataFrame:
    priority = F.when(F.col("severity") == "error", "p0").when(F.col("severity") == "warning", "p1").otherwise("p2")
    return issues.select(F.concat_ws(":", "rule_id", F.col("doc_id").cast("string")).alias("finding_id"), priority.alias("priority"), "source", F.col("doc_id").alias("position"))


def hotspot_findings(hotspots: DataFrame) -> DataFrame:
    """hotspots(path, risk, issues) as findings: p1 if issues are linked and the risk is 70 or more, else p2."""
    priority = F.when((F.col("issues") > 0) & (F.col("risk") >= 70), "p1").otherwise("p2")
    return hotspots.select(F.concat(F.lit("hotspot:"), F.col("path").cast("string")).alias("finding_id"), priority.alias("priority"), F.lit("hotspot").alias("source"), F.col("path").alias("position"))


def conflict_findings(conflicts: DataFrame) -> DataFrame:
    """conflicts(place, kind, severity) as findings, by severity as issues."""
    priority = F.when(F.col("severity") == "error", "p0").when(F.col("severity") == "warning", "p1").otherwise("p2")
    return conflicts.select(F.concat_ws(":", F.lit("conflict"), "kind", F.col("place").cast("string")).alias("finding_id"), priority.alias("priority"), F.lit("coordination").alias("source"), F.col("place").alias("position"))


def unused(declared: DataFrame, used: DataFrame, key: str) -> DataFrame:
    return declared.select(key).distinct().join(used.select(key).distinct(), key, "left_anti")


def budget_prefix(ranked: DataFrame, size: Column, order: list, budget: int, by: tuple = ()) -> DataFrame:
    """The longest prefix of each group's ranked rows whose sizes stay within the budget."""
    return running(ranked, order, size, "used", by).where(F.col("used") <= budget)


def page(ranked: DataFrame, order: list, number: int, size: int, by: tuple = ()) -> DataFrame:
    """Rows of one page of each group, counted from 0; sizes from 1 to 500."""
    size = min(max(size, 1), 500)
    placed = numbered(ranked, order, "place", by).withColumn("place", F.col("place") - 1)
    return placed.where((F.col("place") >= number * size) & (F.col("place") < (number + 1) * size))


def page_after(ranked: DataFrame, order: list, size: int = 50, cursor: tuple[int, str] | None = None) -> DataFrame:
    """The page that a cursor (offset, checksum) points to, of 1 to 500 rows, with place, total and the next page's offset and
    checksum. The checksum is that of the number of rows: where it differs from the cursor's, paging begins anew."""
    size, total = min(max(size, 1), 500), ranked.count()
    checksum = f"len:{total}"
    offset = cursor[0] if cursor and cursor[1] == checksum else 0
    rows = numbered(ranked, order, "place").where((F.col("place") > offset) & (F.col("place") <= offset + size))
    following = F.lit(offset + size if offset + size < total else None).cast("long")
    return rows.withColumns({"total": F.lit(total).cast("long"), "next_offset": following, "checksum": F.lit(checksum)})


#: Repeated use is ready from so many different pull requests and repositories that have several.
READY_PRS, READY_REPOS = 3, 1


def feedback_ready(feedback: DataFrame, least: int = 2) -> DataFrame:
    """(prs, repeated_repos, ready): different pull requests, and repositories with several."""
    repos = feedback.groupBy("repo").agg(F.countDistinct("pr").alias("n")).agg(F.count_if(F.col("n") >= least).alias("repeated_repos"))
    rows = feedback.agg(F.countDistinct("pr").alias("prs")).crossJoin(F.broadcast(repos))
    return rows.withColumn("ready", (F.col("prs") >= READY_PRS) & (F.col("repeated_repos") >= READY_REPOS))


def kept_from_dead(path: Column, entries: tuple = ()) -> Column:
    """Whether a file is never dead for want of importers: tests, barrels, and public entries with or without extension."""
    base = F.substring_index(path, "/", -1)
    stem = lambda c: F.regexp_replace(c, r"(?<=[^/])\.[^./]+$", "")
    test = path.rlike(r"\.test\.|\.spec\.|__tests__|^tests/|/tests/") | base.rlike(r"^test_.+\.py$|^.+_test\.py$")
    public = path.isin(*entries) | stem(path).isin(*entries) if entries else F.lit(False)
    return test | stem(base).isin("index", "__init__") | public | path.startswith("src/index") | path.startswith("index.")


def dead_files(files: DataFrame, edges: DataFrame, exports: DataFrame, entries: tuple = ()) -> DataFrame:
    """Files of files(path) that export a name, that no other file of edges(src, dst) imports, and that nothing keeps."""
    rows = files.select("path").distinct().join(exports.select("path").distinct(), "path", "left_semi")
    used = edges.where("src <> dst").select(F.col("dst").alias("path")).distinct()
    return rows.join(used, "path", "left_anti").where(~kept_from_dead(F.col("path"), entries))


def feedback_summary(feedback: DataFrame) -> DataFrame:
    return feedback.agg(
        F.count("*").alias("entries"), F.count_if("useful").alias("useful"), F.countDistinct("repo").alias("repos"), F.countDistinct("pr").alias("prs"),
        F.sum("minutes").alias("minutes"), round_half_up(F.avg("minutes"), 2).alias("mean_minutes"), F.max("minutes").alias("most_minutes"),
    )


def repeat_use(feedback: DataFrame, least: int = 2) -> DataFrame:
    return feedback.groupBy("repo").agg(F.countDistinct("pr").alias("prs")).where(F.col("prs") >= least)


def set_fingerprint(df: DataFrame, by: str, member: str) -> DataFrame:
    """SHA-256 over each group's distinct members in order."""
    return df.groupBy(by).agg(F.sha2(F.array_join(F.sort_array(F.collect_set(F.col(member).cast("string"))), "\n"), 256).alias("fingerprint"))


def content_fingerprint(files: DataFrame, by: str, path: str = "path", content: str = "content") -> DataFrame:
    """(by, fingerprint): SHA-256 over each group's files, names and contents, in 256 parts by the hash of the name, so that no
    array holds a whole group. The order of rows does not matter; a null content is told from an empty one."""
    name = F.coalesce(F.col(path).cast("string"), F.lit(""))
    each = files.select(by, F.sha2(name, 256).alias("place"), F.sha2(F.coalesce(F.concat(F.lit("+"), F.col(content)), F.lit("-")), 256).alias("digest")).distinct()
    part = each.groupBy(by, F.substring("place", 1, 2).alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("place", F.lit(" "), "digest"))), "\n"), 256).alias("digest"))
    return part.groupBy(by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("part", F.lit(" "), "digest"))), "\n"), 256).alias("fingerprint"))


def group_rollup(deps: DataFrame, *levels: str) -> DataFrame:
    return deps.rollup(*levels).agg(F.count("*").alias("n"))


def package_scope(files: DataFrame, packages: DataFrame, name: str) -> DataFrame:
    """The files of one package."""
    return longest_prefix(files, packages).where(F.col("name") == name).select("path")


def collect_issues(parts: list[DataFrame]) -> DataFrame:
    """The issues of all analyzers, errors first, then warnings; missing columns are null."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return rows.orderBy(rank, "rule_id")
