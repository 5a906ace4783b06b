"""Dependencies and files: risks, licences, sizes, frameworks, unused packages, upgrade marks, scans of scripts and payloads, purposes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolode.operators.evidence import small_rules
from cartolode.operators.mentions import mentions

#: Packages that are deprecated and packages that are heavy.
DEPRECATED = ("moment", "request", "node-uuid", "nomnom", "coffee-script")
HEAVY = ("lodash", "underscore", "jquery")
#: Packages used without an import, by beginning of the name and whole.
IMPLICIT_PREFIXES = (
    "@types/", "eslint-plugin-", "eslint-config-", "prettier-plugin-", "postcss-plugin-", "rollup-plugin-", "vite-plugin-",
    "babel-plugin-", "babel-preset-", "stylelint-plugin-", "stylelint-config-", "tree-sitter-",
)
IMPLICIT_NAMES = (
    "typescript ts-node tsx tsup esbuild vite webpack rollup parcel eslint prettier stylelint husky lint-staged commitlint "
    "@commitlint/config-conventional semantic-release nx lerna rimraf cross-env concurrently nodemon npm-run-all only-allow zx chokidar "
    "react-scripts next nuxt vitest jest mocha ava tap jasmine @playwright/test cypress storybook @storybook/react"
).split()
#: Frameworks by the dependency that shows them, and their category.
FRAMEWORKS = (
    ("react", "React", "frontend"), ("react-dom", "React", "frontend"), ("next", "Next.js", "frontend"), ("vue", "Vue.js", "frontend"),
    ("nuxt", "Nuxt.js", "frontend"), ("svelte", "Svelte", "frontend"), ("@sveltejs/kit", "SvelteKit", "frontend"), ("angular", "Angular", "frontend"),
    ("@angular/core", "Angular", "frontend"), ("solid", "Solid.js", "frontend"), ("solid-js", "Solid.js", "frontend"), ("express", "Express", "backend"),
    ("fastify", "Fastify", "backend"), ("@nestjs/core", "NestJS", "backend"), ("hono", "Hono", "backend"), ("koa", "Koa", "backend"),
    ("socket.io", "Socket.IO", "backend"), ("vitest", "Vitest", "testing"), ("jest", "Jest", "testing"), ("mocha", "Mocha", "testing"),
    ("cypress", "Cypress", "testing"), ("playwright", "Playwright", "testing"), ("@playwright/test", "Playwright", "testing"), ("vite", "Vite", "bundler"),
    ("webpack", "Webpack", "bundler"), ("rollup", "Rollup", "bundler"), ("esbuild", "esbuild", "bundler"), ("turbo", "Turborepo", "bundler"),
    ("tailwindcss", "Tailwind CSS", "css"), ("styled-components", "styled-components", "css"), ("@emotion/react", "Emotion", "css"),
    ("prisma", "Prisma", "other"), ("@prisma/client", "Prisma", "other"), ("drizzle", "Drizzle ORM", "other"), ("drizzle-orm", "Drizzle ORM", "other"),
    ("mongoose", "Mongoose", "other"), ("typeorm", "TypeORM", "other"), ("sequelize", "Sequelize", "other"), ("graphql", "GraphQL", "other"),
    ("apollo-server", "Apollo Server", "backend"), ("@apollo/server", "Apollo Server", "backend"), ("trpc", "tRPC", "backend"), ("@trpc/server", "tRPC", "backend"),
)
#: Lines of a change log that announce a break.
BREAKING = r"(?i)BREAKING\s+CHANGE|^#{1,6}.*breaking|\*\s*Breaking:|deprecat|removed\s+support|no\s+longer\s+supported"
#: What obfuscated scripts hold.
OBFUSCATION = (r"while\s*\(\s*!!\[\]\s*\)", r"(?i)_0x[a-f0-9]{4,}", r"String\s*\[\s*['\"]fromCharCode['\"]\s*\]", r"\bFunction\s*\(\s*['\"]", r"\beval\s*\(")
LIFECYCLE = ("preinstall", "install", "postinstall", "prepare", "prepublish", "prepublishOnly")
COPYLEFT = r"(?i)\b(?:AGPL|GPL|LGPL|SSPL)\b"
#: The label of a file by its lower-case base name, which holds the word or is it; the first that fits.
NAME_PURPOSES = (
    ("holds", "config", "Configuration file"),
    ("holds", "rc", "Configuration file"),
    ("is", "index", "Module entry point / barrel file"),
    ("is", "main", "Application entry point"),
    ("is", "app", "Application entry point"),
    ("holds", "route", "Route definitions"),
    ("holds", "router", "Route definitions"),
    ("holds", "middleware", "Middleware handler"),
    ("holds", "controller", "Request controller"),
    ("holds", "service", "Service layer logic"),
    ("holds", "model", "Data model / schema definition"),
    ("holds", "schema", "Data model / schema definition"),
    ("holds", "util", "Utility functions"),
    ("holds", "helper", "Utility functions"),
    ("holds", "hook", "Custom hook"),
    ("holds", "context", "Context / state provider"),
    ("holds", "provider", "Context / state provider"),
    ("holds", "type", "Type definitions"),
    ("holds", "interface", "Type definitions"),
    ("holds", "constant", "Constants / configuration"),
    ("holds", "migration", "Database migration"),
    ("holds", "seed", "Database seed data"),
    ("holds", "auth", "Authentication logic"),
    ("holds", "api", "API endpoint handler"),
)
#: The label by a word that the lower-case folder holds, for names that have none.
FOLDER_PURPOSES = (
    ("component", "UI component"),
    ("pages", "UI component"),
    ("service", "Service module"),
    ("model", "Data model"),
    ("util", "Library / utility module"),
    ("lib", "Library / utility module"),
)


def dependency_risks(deps: DataFrame, licences: DataFrame, workspace: str = "workspace") -> DataFrame:
    """deps(workspace, name, version, dev) and licences(workspace, name, licence) to (workspace, name, rule, severity)."""
    w, prod = workspace, deps.where("not dev")
    row = lambda df, rule, severity, name="name": df.select(w, F.col(name).alias("name"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))
    total = prod.groupBy(w).agg(F.countDistinct("name").alias("n"))
    sized = total.where("n > 50").select(w, F.when(F.col("n") > 100, "excessive-dependencies").otherwise("many-dependencies").alias("name"), F.lit("count").alias("rule"), F.when(F.col("n") > 100, "high").otherwise("medium").alias("severity"))
    parts = [
        row(deps.where(F.col("name").isin(*DEPRECATED)), "deprecated", "high"),
        row(prod.where(F.col("name").isin(*HEAVY)), "heavy", "medium"),
        sized,
        row(prod.where("version = '*' or startswith(version, '>=')"), "wildcard", "high"),
        row(licences.where(F.col("licence").rlike(COPYLEFT)), "copyleft", "high"),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def missing_lockfiles(deps: DataFrame, files: DataFrame, by: str = "repo") -> DataFrame:
    """Repositories of deps(by, name) none of whose files(by, path) at the root is a lockfile: (by, rule, severity)."""
    locked = files.where(F.col("path").isin("package-lock.json", "yarn.lock", "pnpm-lock.yaml")).select(by).distinct()
    return deps.select(by).distinct().join(locked, by, "left_anti").select(by, F.lit("no-lockfile").alias("rule"), F.lit("medium").alias("severity"))


def licence_summary(packages: DataFrame, licence: str = "licence") -> DataFrame:
    """(licence, packages, copyleft); packages without one count as UNKNOWN."""
    rows = packages.groupBy(F.coalesce(licence, F.lit("UNKNOWN")).alias("licence")).agg(F.count("*").alias("packages"))
    return rows.withColumn("copyleft", F.col("licence").rlike(COPYLEFT))


def size_summary(packages: DataFrame, by: str = "workspace", top: int = 10) -> DataFrame:
    """packages(by, name, bytes) to (by, total_bytes, missing, largest): a null size is a package that is not installed. largest
    lists the names of the top by size, each task keeping no more than those."""
    totals = packages.groupBy(by).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"), F.count_if(F.col("bytes").isNull()).alias("missing"))
    order = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("bytes"), "name"))
    first = packages.where("bytes is not null").withColumn("place", order).where(F.col("place") <= top)
    names = first.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]), ",").alias("largest"))
    return totals.join(names, by, "left")


def detect_frameworks(deps: DataFrame, by: str = "workspace") -> DataFrame:
    """(by, framework, category) that the names of deps(by, name) show."""
    known = F.create_map(*[x for n, f, c in FRAMEWORKS for x in (F.lit(n), F.struct(F.lit(f).alias("framework"), F.lit(c).alias("category")))])
    return deps.select(by, known[F.col("name")].alias("x")).where("x is not null").select(by, "x.framework", "x.category").distinct()


def implicitly_used(name: Column) -> Column:
    return reduce(lambda a, p: a | name.startswith(p), IMPLICIT_PREFIXES, name.isin(*IMPLICIT_NAMES))


def unused_dependencies(deps: DataFrame, imports: DataFrame, scripts: DataFrame, by: str = "workspace") -> DataFrame:
    """deps(by, name, dev) that no file of the workspace imports(by, name), no script(by, value) calls and nothing uses by
    convention: (by, name, severity)."""
    words = scripts.select(by, F.explode(F.split("value", r"[\s&|;]+")).alias("name")).where("name <> ''").distinct()
    rows = deps.where(~implicitly_used(F.col("name"))).groupBy(by, "name").agg(F.max("dev").alias("dev"))
    for used in (imports.select(by, "name").distinct(), words):
        rows = rows.join(used, [by, "name"], "left_anti")
    return rows.select(by, "name", F.when(F.col("dev"), "info").otherwise("warning").alias("severity"))


def breaking_lines(logs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, excerpt) for each line of a change log that announces a break."""
    lines = logs.select(key, F.posexplode(F.split(F.col(text), "\r?\n", -1)).alias("k", "x"))
    return lines.where(F.col("x").rlike(BREAKING)).select(key, (F.col("k") + 1).alias("line"), F.trim("x").alias("excerpt"))


def upgrade_evidence(imports: DataFrame, marks: DataFrame) -> DataFrame:
    """imports(path, name) and marks(name, ...) of change logs to (name, importers, marks)."""
    used = imports.groupBy("name").agg(F.countDistinct("path").alias("importers"))
    return used.join(marks.groupBy("name").agg(F.count("*").alias("marks")), "name", "full").fillna(0, ["importers", "marks"])


def lifecycle_scripts(scripts: DataFrame) -> DataFrame:
    """Scripts(manifest, name, value) that an installation runs; `prepare` only if it calls an interpreter, a download or a pipe."""
    risky = F.col("value").rlike(r"(?i)\b(?:bun|node|deno|python|ruby|bash|sh|curl|wget|powershell|pwsh|npx)\b|\b(?:npm\s+exec|pnpm\s+dlx|yarn\s+dlx)\b|&&|\|")
    return scripts.where(F.col("name").isin(*LIFECYCLE)).where((F.col("name") != "prepare") | risky)


def payload_scan(files: DataFrame, indicators: DataFrame, names: tuple = (), least_bytes: int = 1 << 20, most_bytes: int = 5 << 20) -> DataFrame:
    """files(path, size_bytes, content) to (path, finding, severity). A listed name comes first; of files within the two
    sizes, one that holds a row of indicators(value, label), then one with two marks of obfuscation, or with one and a line
    of over 50,000 characters among the first four. Indicators are written by hand and broadcast if few."""
    named = F.substring_index("path", "/", -1).isin(*names) if names else F.lit(False)
    rows = files.withColumn("named", named).withColumn("big", F.col("size_bytes").between(least_bytes, most_bytes))
    hits = rows.where("big and not named").join(small_rules(indicators), F.expr("contains(content, value)")).groupBy("path").agg(F.min("label").alias("label"))
    marks = reduce(lambda a, p: a + F.col("content").rlike(p).cast("int"), OBFUSCATION, F.lit(0))
    long_line = F.exists(F.slice(F.split("content", "\r?\n"), 1, 4), lambda x: F.length(x) > 50_000)
    found = F.when(F.col("named"), "payload-file").when(F.col("label").isNotNull(), "indicator").when(F.col("big") & ((marks >= 2) | ((marks >= 1) & long_line)), "obfuscated")
    rows = rows.join(hits, "path", "left").select("path", found.alias("finding")).where("finding is not null")
    return rows.withColumn("severity", F.when(F.col("finding") == "obfuscated", "warning").otherwise("error"))


def audit_issues(reports: DataFrame, text: str = "value") -> DataFrame:
    """Audit reports as JSON with a map of vulnerabilities to issues (rule_id, severity, category, fix_available)."""
    kind = "struct<vulnerabilities: map<string, struct<severity: string, fixAvailable: string>>>"
    rows = reports.select(F.explode(F.from_json(F.col(text), kind)["vulnerabilities"]).alias("name", "v"))
    severity = F.when(F.col("v.severity").isin("critical", "high"), "error").when(F.col("v.severity") == "moderate", "warning").otherwise("info")
    fix = F.coalesce(F.col("v.fixAvailable") != "false", F.lit(False))
    return rows.select(F.concat(F.lit("audit-"), "name").alias("rule_id"), severity.alias("severity"), F.lit("security").alias("category"), fix.alias("fix_available"))


def infer_purpose(path: Column, exports: Column | None = None) -> Column:
    """What a file is for, by its name, then its folder; else by whether it exports anything."""
    base = F.lower(F.substring_index(path, "/", -1))
    name, folder = F.regexp_replace(base, r"(?<=.)\.[^.]*$", ""), F.lower(F.regexp_extract(path, "^(.*)/[^/]*$", 1))
    label = F.when(F.arrays_overlap(F.split(name, r"[\W_]+"), F.array(*map(F.lit, ("test", "tests", "spec", "specs")))), "Test file")
    for mode, word, text in NAME_PURPOSES:
        label = label.when(name == word if mode == "is" else name.contains(word), text)
    for word, text in FOLDER_PURPOSES:
        label = label.when(folder.contains(word), text)
    return label.otherwise("Source file" if exports is None else F.when(F.size(exports) > 0, "Module with exports").otherwise("Source file"))


def architecture_layers(files: DataFrame, frameworks: DataFrame, layers: DataFrame, by: str = "workspace") -> DataFrame:
    """(by, layer, signal) where a folder of files(by, path) or one of frameworks(by, framework) belongs to a layer in
    layers(layer, kind, name), kind being `dir` or `framework`."""
    dirs = files.select(by, F.explode(F.split(F.lower(F.regexp_extract("path", "^(.*)/[^/]*$", 1)), "/")).alias("name"), F.lit("dir").alias("kind"))
    signals = dirs.unionByName(frameworks.select(by, F.col("framework").alias("name"), F.lit("framework").alias("kind"))).distinct()
    return signals.join(small_rules(layers), ["kind", "name"]).select(by, "layer", F.col("name").alias("signal")).distinct()


def command_category(command: Column, categories: dict[str, str]) -> tuple[Column, Column]:
    """A command's first three words in plain characters, and the category of the first."""
    words = F.slice(F.split(F.trim(F.regexp_replace(F.lower(command), "[^a-z0-9:_-]+", " ")), r"\s+"), 1, 3)
    clean = F.coalesce(F.nullif(F.array_join(words, " "), F.lit("")), F.lit("unknown"))
    known = F.create_map(*[F.lit(x) for kv in categories.items() for x in kv])
    return clean, F.coalesce(known[F.substring_index(clean, " ", 1)], F.lit("other"))


def suppress_inline(issues: DataFrame, files: DataFrame, marker: str = "cartolode-ignore-line", key: str = "path", content: str = "content") -> DataFrame:
    """Issues(key, line, rule_id) but for those whose line in files(key, content) holds the marker and then the rule, or a
    beginning of it and `*`; rules stand apart by commas or spaces, and what follows ` -- ` is a reason."""
    lines = files.select(key, F.posexplode(F.split(F.col(content), "\r?\n", -1)).alias("k", "x")).where(F.contains("x", F.lit(marker)))
    rest = F.split(F.trim(F.substring(F.col("x"), F.locate(marker, F.col("x")) + len(marker), F.length("x"))), r"\s+--\s+")[0]
    marks = lines.select(key, (F.col("k") + 1).alias("line"), F.explode(F.split(rest, r"[,\s]+")).alias("rule")).where("rule <> ''").distinct()
    fits = F.expr("if(endswith(rule, '*'), startswith(rule_id, substring(rule, 1, length(rule) - 1)), rule_id = rule)")
    return issues.join(marks.withColumnRenamed(key, "at").withColumnRenamed("line", "at_line"), (F.col(key) == F.col("at")) & (F.col("line") == F.col("at_line")) & fits, "left_anti")


#: Characters that may stand around a path that a text mentions.
BOUNDARY = " \t\n\r\"'`()[]{}:,;.?!<>"


def issues_by_file(issues: DataFrame, files: DataFrame, located: DataFrame) -> DataFrame:
    """(path, rule_id) of located(path, rule_id), and of issues(rule_id, text) without a place that mention the path of a
    file between boundaries."""
    exact = located.join(files.select("path").distinct(), "path", "left_semi").select("path", "rule_id")
    said = mentions(issues, files, "rule_id", name="path", boundary=BOUNDARY)
    return exact.unionByName(said.select(F.col("name").alias("path"), "rule_id")).distinct()


#: How a version names a commit of a repository, by its form without the commit.
COMMIT, COMMIT_HOSTS = r"(?i)#[0-9a-f]{7,40}$", r"(?i)^(?:(?:github:)?[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+(?:\.git)?|(?:git\+https|https|git)://github\.com/.+|(?:git\+ssh|ssh)://git@github\.com[:/].+|git@github\.com:.+)$"
#: Files of editors and agents that may hold hooks, and what such a hook does, in the order in which it is tried.
HOOK_FILES = (".claude/settings.json", ".vscode/settings.json", ".vscode/tasks.json")
HOOKS = (
    ("token monitor", r"(?i)gh-token-monitor"),
    ("lookalike domain", r"(?i)git-tanstack\.com"),
    ("payload name", r"(?i)router_init\.js"),
    ("destructive delete", r"(?i)rm\s+-rf\s+(?:~|\$HOME|/)"),
    ("process control", r"(?i)pkill\s+-f\s+gh-token-monitor"),
    ("download and execute", r"(?i)curl\b.+\|\s*(?:sh|bash)"),
)


def flagged_dependencies(deps: DataFrame, bad: DataFrame, indicators: DataFrame) -> DataFrame:
    """deps(name, spec, ...) with finding and severity: malicious where bad(name, version) lists the exact version; and, apart from
    that, indicator where the spec holds a row of indicators(value, label), else git-commit where it names a commit."""
    spec = F.trim("spec")
    rows = deps.withColumn("spec", spec).where("spec <> ''")
    exact = rows.where(F.col("spec").rlike(r"^\d+\.\d+\.\d+(?:[-+].*)?$"))
    listed = exact.join(small_rules(bad.select("name", F.col("version").alias("spec")).distinct()), ["name", "spec"], "left_semi")
    marked = rows.join(small_rules(indicators.select("value").distinct()), F.expr("contains(spec, value)"), "left_semi")
    bare = F.regexp_replace("spec", "#[^#]*$", "")
    commits = rows.where(F.col("spec").rlike(COMMIT) & bare.rlike(COMMIT_HOSTS)).join(small_rules(indicators.select("value").distinct()), F.expr("contains(spec, value)"), "left_anti")
    tell = lambda df, finding, severity: df.select(*deps.columns, F.lit(finding).alias("finding"), F.lit(severity).alias("severity"))
    return tell(listed, "malicious", "error").unionByName(tell(marked, "indicator", "error")).unionByName(tell(commits, "git-commit", "warning"))


def hidden_hooks(files: DataFrame) -> DataFrame:
    """(path, hook) of files(path, content) of editors and agents whose content fits one of HOOKS, the first of them."""
    mine = reduce(lambda a, f: a | (F.col("path") == f) | F.col("path").endswith("/" + f), HOOK_FILES, F.lit(False))
    hook = reduce(lambda rest, h: F.when(F.col("content").rlike(h[1]), h[0]).otherwise(rest), reversed(HOOKS), F.lit(None).cast("string"))
    return files.where(mine).select("path", hook.alias("hook")).where("hook is not null")


def dependency_totals(deps: DataFrame, by: str = "workspace") -> DataFrame:
    """(by, direct, development, total) of deps(by, name, dev), names once, by workspace and, where by is null, over all of them."""
    once = deps.select(by, "name", "dev").distinct()
    n = [F.count_if(~F.col("dev")).alias("direct"), F.count_if("dev").alias("development"), F.count("*").alias("total")]
    return once.where(f"{by} is not null").groupBy(by).agg(*n).unionByName(once.select("name", "dev", by).agg(*n).select(F.lit(None).cast(deps.schema[by].dataType).alias(by), "direct", "development", "total"))
