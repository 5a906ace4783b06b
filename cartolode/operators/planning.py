"""Planning of changes: profiles of files, top risks, conflicts, likely tests, budgets of caution and proof debt, ranked evidence cards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolode.operators.mentions import mentions

#: Kinds of proof debt.
DEBT_KINDS = ("missing-contract", "scope-drift", "missing-proof", "failed-proof", "stale-proof", "weak-proof", "recipe-gap")
#: Sources of a caution that people sign off, and how the others rank.
SIGN_OFF = ("release", "changed-files", "hotspots", "session", "coordination")
SOURCE_RANK = {"doctor": 0, "taint": 0, "plugin": 0, "supply-chain": 0, "review": 1, "release": 2}
CARD_SOURCE_RANK = {"doctor": 0, "issue": 0, "preflight": 1, "hotspot": 2, "coordination": 3, "session": 3}
PRIORITY_RANK = {"p0": 0, "p1": 1}
TRUST_RANK = {"helpful": 0, "none": 1, "suppressed": 2, "mixed": 3}
TRUST_DELTA = {"helpful": 12, "suppressed": -4, "mixed": -8, "noisy": -16}
#: Categories of feedback, each with the patterns that a text must all fit; the first that fits.
FEEDBACK = (
    ("install_warning", r"\b(?:npm|npx|install|installed|global|globally)\b", r"allow[- ]scripts?|install scripts?|node-gyp-build|tree-sitter"),
    ("false_positive", r"\bfalse[- ]positive\b|incorrectly flag|wrongly flag|flagged unused|reported unused|not actually unused"),
    ("noisy_caution", r"\bcaution\b|\bwarning\b", r"noise|noisy|background|too many|low[- ]signal|spam"),
    (
        "missing_framework_rule",
        r"missing|not detected|not detect|does not detect|doesn't detect|should detect|misses",
        r"framework|next\.?js|app router|route handler|middleware|koa|hono|fastify|express|sveltekit|astro|remix|request source|ctx\.request",
    ),
    ("confusing_docs_output", r"docs|readme|output|wording|message|copy", r"confusing|unclear|bigger than|overclaim|overstate|sounds bigger|not demonstrated"),
    (
        "workflow_focus",
        r"feature breadth|breadth|too many features|feature[s]?.*without.*workflow|killer workflow|killer workflows|trusted daily|trust daily|daily workflow|daily workflows",
    ),
    ("useful_signal", r"\buseful\b|saved .*minute|prevented|caught|helped|trusted|clear next"),
)
#: Words that say nothing about a finding.
GENERIC = "background card edit false finding hotspot noisy positive prevented proof signal useful".split()


def lookup(col: Column, table: dict, other) -> Column:
    return reduce(lambda c, kv: c.when(col == kv[0], kv[1]), table.items(), F.when(F.lit(False), None)).otherwise(other)


def file_profile(files: DataFrame, coupled: DataFrame, functions: DataFrame, issues: DataFrame, ranked: DataFrame) -> DataFrame:
    """Per file of files(path): fan-in and fan-out (0 where nothing is known), functions(path, name, cc) by count, largest
    complexity and the function that has it, issues(path, ...) by count, and the risk of ranked(path, risk)."""
    worst = functions.groupBy("path").agg(F.count("*").alias("functions"), F.max("cc").alias("cc"), F.max(F.struct("cc", "name"))["name"].alias("worst_function"))
    rows = files.select("path").distinct().join(coupled.select("path", "fan_in", "fan_out"), "path", "left").join(worst, "path", "left")
    rows = rows.join(issues.groupBy("path").agg(F.count("*").alias("issues")), "path", "left").join(ranked.select("path", "risk"), "path", "left")
    return rows.fillna(0, ["fan_in", "fan_out", "functions", "issues"])


def functions_by_complexity(functions: DataFrame, top: int | None = None) -> DataFrame:
    """functions(path, name, line, cc) with rank in their file: the most complex first, then by line and name."""
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("cc"), "line", "name"))
    rows = functions.withColumn("rank", rank)
    return rows if top is None else rows.where(F.col("rank") <= top)


def top_risks(reasons: DataFrame, owners: DataFrame, top: int = 8, by: str = "workspace") -> DataFrame:
    """reasons(by, place, source, message, severity, file), each (source, file, message) once and where it came first, by
    priority and place, then by source, message and file; errors are p0, the rest p1. owners(path, owner) name the owner of the file. The top of each group."""
    first = reasons.groupBy(by, "source", "message", "file").agg(F.min(F.struct("place", "severity")).alias("x")).select(by, "source", "message", "file", "x.place", "x.severity")
    rows = first.withColumn("priority", F.when(F.col("severity") == "error", "p0").otherwise("p1"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("priority", "place", "source", "message", "file"))).where(F.col("rank") <= top)
    return rows.join(owners.select(F.col("path").alias("file"), "owner"), "file", "left").select(by, "rank", "priority", "source", "message", "file", "owner")


def workspace_key(path: Column) -> Column:
    """`packages/x` or `apps/x` below those folders, else the first part."""
    return F.coalesce(F.nullif(F.regexp_extract(path, "^((?:packages|apps)/[^/]+)", 1), F.lit("")), F.substring_index(path, "/", 1))


def session_conflicts(touches: DataFrame, edges: DataFrame, by: str = "session") -> DataFrame:
    """touches(by, place, path) to (by, kind, file_a, file_b): each file touched more than once, the first two files of one
    workspace in order of place, and the first two files that edges(src imports dst) connect."""
    same = touches.groupBy(by, "path").agg(F.count("*").alias("n")).where("n > 1").select(by, F.lit("same-file").alias("kind"), F.col("path").alias("file_a"), F.lit(None).cast("string").alias("file_b"))
    files = touches.groupBy(by, "path").agg(F.min("place").alias("place"))
    before = F.lag("path").over(Window.partitionBy(by, workspace_key(F.col("path"))).orderBy("place", "path"))
    pairs = files.withColumn("file_a", before).where("file_a is not null")
    area = pairs.groupBy(by).agg(F.min(F.struct("place", "path", "file_a")).alias("x")).select(by, F.lit("same-workspace").alias("kind"), "x.file_a", F.col("x.path").alias("file_b"))
    near = files.withColumnRenamed("path", "dst").join(edges.where("src <> dst"), "dst").join(files.select(by, F.col("path").alias("src")), [by, "src"], "left_semi")
    linked = near.groupBy(by).agg(F.min(F.struct("place", "dst", "src")).alias("x")).select(by, F.lit("import-related").alias("kind"), F.col("x.src").alias("file_a"), F.col("x.dst").alias("file_b"))
    return same.unionByName(area).unionByName(linked)


def base_name(path: Column) -> Column:
    """The lower-case file name without its extension."""
    return F.regexp_replace(F.lower(F.substring_index(path, "/", -1)), r"\.[^.]+$", "")


def likely_tests(tests: DataFrame, candidates: DataFrame) -> DataFrame:
    """(test, score): 100 where a test is named as a candidate file is, 40 where its path holds such a name of three
    characters or more; the best score of each test."""
    names = candidates.select(base_name(F.col("path")).alias("name")).distinct()
    tested = tests.select(F.col("path").alias("test"), F.regexp_replace(F.regexp_replace(F.lower(F.substring_index("path", "/", -1)), r"\.(test|spec)\.[^.]+$", ""), r"\.[^.]+$", "").alias("name"))
    exact = tested.join(names, "name", "left_semi").select("test", F.lit(100).alias("score"))
    part = mentions(tests.select(F.col("path").alias("test"), F.lower("path").alias("text")), names.where(F.length("name") >= 3), "test").select("test", F.lit(40).alias("score"))
    return exact.unionByName(part).groupBy("test").agg(F.max("score").alias("score"))


def plan_terms(text: Column) -> Column:
    """Lower-case words of two characters or more, camel humps apart."""
    return F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+"), lambda t: F.length(t) > 1))


def rank_candidates(plans: DataFrame, files: DataFrame, weak: tuple = (), key: str = "plan_id") -> DataFrame:
    """plans(key, text) against files(path, fan, at_risk) to (key, path, score): 80 for a path that the plan mentions, 70 for a
    file name, 60 for a name without extension, which needs to be a term of the plan if it is shorter than three characters;
    12 a term of three characters or more that both share; and, where there is any of those, 8 at risk and up to 10 for the
    fan. A mention counts inside longer words too."""
    terms = plans.select(key, F.explode(plan_terms(F.col("text"))).alias("term"))
    stem = base_name(F.col("path"))
    each = files.select("path", F.explode(plan_terms(F.concat_ws(" ", "path", F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]+$", "")))).alias("term"))
    strong = (F.length("term") > 2) & (~F.col("term").isin(*weak) if weak else F.lit(True))
    shared = terms.where(strong).join(each, "term").groupBy(key, "path").agg(F.count("*").alias("shared"))
    names = files.select("path", F.explode(F.array(F.struct(F.lower("path").alias("name"), F.lit(80).alias("n")), F.struct(F.lower(F.substring_index("path", "/", -1)).alias("name"), F.lit(70).alias("n")), F.struct(F.when(F.length(stem) >= 3, stem).alias("name"), F.lit(60).alias("n")))).alias("x")).select("path", "x.*").where("name <> ''")
    held = mentions(plans.select(key, F.lower("text").alias("text")), names, key).join(names, "name").select(key, "path", "n")
    short = terms.join(files.select("path", stem.alias("term")).where(F.length("term") < 3), "term").select(key, "path", F.lit(60).alias("n"))
    said = held.unionByName(short).groupBy(key, "path").agg(F.max("n").alias("mention"))
    rows = shared.join(said, [key, "path"], "full").fillna(0).join(files, "path")
    score = F.col("mention") + 12 * F.col("shared") + F.when(F.col("at_risk"), 8).otherwise(0) + F.least(F.lit(10), F.col("fan"))
    return rows.select(key, "path", score.cast("long").alias("score"))


def review_verdict(signals: DataFrame, by: str) -> DataFrame:
    """signals(by, max_risk, new_cycles, expanded_cycles, risky_functions, new_flows): block, review or ok."""
    c = F.col
    block = (c("max_risk") >= 80) | (c("new_cycles") > 0) | (c("new_flows") > 0)
    review = (c("max_risk") >= 40) | (c("expanded_cycles") > 0) | (c("risky_functions") > 0)
    return signals.select(by, F.when(block, "block").when(review, "review").otherwise("ok").alias("verdict"))


def diff_flows(base: DataFrame, head: DataFrame, touched: DataFrame, keys: tuple = ("source", "sink")) -> DataFrame:
    """Flows(keys, files) of head that base lacks and one of whose files is in touched(path)."""
    new = head.join(base.select(*keys).distinct(), list(keys), "left_anti")
    near = new.select(*keys, F.explode("files").alias("path")).join(touched.select("path").distinct(), "path", "left_semi").select(*keys).distinct()
    return new.join(near, list(keys), "left_semi")


def graph_evidence(changed: DataFrame, functions: DataFrame, by: str = "workspace") -> DataFrame:
    """Per group: changed files, functions in them, and functions in all of functions(by, path, name)."""
    files = changed.groupBy(by).agg(F.countDistinct("path").alias("changed_files"))
    touched = functions.join(changed.select(by, "path").distinct(), [by, "path"], "left_semi").groupBy(by).agg(F.count("*").alias("changed_functions"))
    return files.join(touched, by, "left").join(functions.groupBy(by).agg(F.count("*").alias("total_functions")), by, "left").fillna(0)


def top_packages(imports: DataFrame, by: str = "workspace", top: int = 5) -> DataFrame:
    """The packages that most files of imports(by, path, name) import: (by, name, importers, rank)."""
    rows = imports.groupBy(by, "name").agg(F.countDistinct("path").alias("importers"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("importers"), "name"))).where(F.col("rank") <= top)


def proof_requirements(files: DataFrame, commands: DataFrame, by: str = "workspace") -> DataFrame:
    """files(by, path, surface) and commands(by, place, command) to (by, surface, files, commands): how many files a surface
    has and how many commands it requires. Documentation and generated files need none; config, security and dependency
    need all; others the tests and the first other command."""
    is_test = F.col("command").rlike(r"^npm (?:run )?test\b")
    known = commands.groupBy(by).agg(F.countDistinct(F.when(is_test, F.col("command"))).alias("tests"), F.countDistinct(F.when(~is_test, F.col("command"))).alias("others"))
    rows = files.groupBy(by, "surface").agg(F.countDistinct("path").alias("files")).join(known, by, "left").fillna(0, ["tests", "others"])
    needed = F.when(F.col("surface").isin("documentation", "generated"), F.lit(0)).when(F.col("surface").isin("config", "security", "dependency"), F.col("tests") + F.col("others")).otherwise(F.col("tests") + F.least("others", F.lit(1)))
    return rows.select(by, "surface", "files", needed.cast("long").alias("commands"))


def caution_budget(reasons: DataFrame, by: str = "workspace") -> DataFrame:
    """Warnings of reasons(by, place, source, severity, message) with what to do, fix_now or manual_signoff, and the primary
    one of each group: to fix first, then by source and place."""
    scale = (F.col("source") == "review") & F.contains("message", F.lit("scale/complexity")) & ~F.col("message").rlike("new import cycle|taint|dataflow")
    rows = reasons.where("severity = 'warning'").withColumn("action", F.when(F.col("source").isin(*SIGN_OFF) | scale, "manual_signoff").otherwise("fix_now"))
    order = Window.partitionBy(by).orderBy("action", lookup(F.col("source"), SOURCE_RANK, 3), "place", "source", "message", "file")
    return rows.withColumn("primary", F.row_number().over(order) == 1)


def proof_debt(gaps: DataFrame, by: str = "workspace") -> DataFrame:
    """Distinct gaps(by, kind, severity, message, command, file) by kind, 0 where there are none: (by, kind, n)."""
    rows = gaps.select(by, "kind", "severity", "message", "command", "file").distinct()
    counts = rows.groupBy(by).agg(F.array(*[F.struct(F.lit(k).alias("kind"), F.count_if(F.col("kind") == k).alias("n")) for k in DEBT_KINDS]).alias("x"))
    return counts.select(by, F.inline("x"))


def gate_status(debt: DataFrame, broker: DataFrame, by: str = "workspace") -> DataFrame:
    """debt(by, kind, n) and the broker(by, status) that it came with: drifted, blocked, needs-proof, or the broker's status."""
    n = debt.groupBy(by).agg(F.sum("n").alias("total"), *[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(a) for k, a in (("scope-drift", "drift"), ("missing-contract", "bare"), ("failed-proof", "failed"))])
    c = F.col
    status = F.when(c("drift") > 0, "drifted").when(c("bare") + c("failed") > 0, "blocked").when(c("status").isin("blocked", "drifted"), c("status")).when(c("total") > 0, "needs-proof").otherwise(c("status"))
    return broker.join(n, by, "left").fillna(0, ["total", "drift", "bare", "failed"]).select(by, status.alias("status"))


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def trust_memory(cards: DataFrame, feedback: DataFrame, key: str = "card_id") -> DataFrame:
    """cards(key, text) and feedback(note, useful) to (key, helpful, noisy, status): a note counts for a card that holds all of
    it, or holds two of its words of four characters or more (one, if it has one), common words left out. Notes and words
    count inside longer words too."""
    notes = feedback.select(_plain(F.col("note")).alias("note"), "useful").where("note <> ''").groupBy("note").agg(F.count_if("useful").alias("up"), F.count_if(~F.col("useful")).alias("down"))
    words = F.filter(F.array_distinct(F.split("note", " ")), lambda t: (F.length(t) >= 4) & ~t.isin(*GENERIC))
    wanted = notes.select("note", words.alias("words")).withColumn("need", F.least(F.lit(2), F.size("words")))
    said = wanted.select("note", "need", F.explode("words").alias("name"))
    held = mentions(cards.select(key, _plain(F.col("text")).alias("text")), said.select("name").union(notes.select("note")), key)
    some = held.join(said, "name").groupBy(key, "note", "need").agg(F.count("*").alias("n")).where("n >= need").select(key, "note")
    fits = some.union(held.join(notes.select(F.col("note").alias("name")), "name").select(key, "name")).distinct()
    sums = fits.join(notes, "note").groupBy(key).agg(F.sum("up").alias("helpful"), F.sum("down").alias("noisy"))
    rows = cards.select(key).join(sums, key, "left").fillna(0, ["helpful", "noisy"])
    c = F.col
    return rows.withColumn("status", F.when((c("helpful") > 0) & (c("noisy") > 0), "mixed").when(c("helpful") > 0, "helpful").when(c("noisy") > 0, "noisy").otherwise("none"))


def rank_cards(cards: DataFrame, by: str = "workspace") -> DataFrame:
    """cards(by, place, finding, file, source, priority, sources, commands, files, has_doctor, has_test, trust) once a file and
    finding, with evidence strength 0 to 100, its level, rank and score: (by, place, strength, level, rank, score)."""
    c = F.col
    once = Window.partitionBy(by, F.coalesce("file", F.col("place").cast("string")), "finding").orderBy("place", "source", "priority")
    rows = cards.withColumn("n", F.row_number().over(once)).where("n = 1")
    doctor = (c("source") == "doctor") | c("has_doctor")
    strength = F.least(F.lit(45), 25 * c("sources")) + F.least(F.lit(20), 8 * c("commands")) + F.when(c("files") > 0, 10).otherwise(0) + F.when(doctor, 25).otherwise(0) + F.when(c("has_test"), 10).otherwise(0)
    rows = rows.withColumn("strength", F.least(F.lit(100), strength).cast("long"))
    order = Window.partitionBy(by).orderBy(lookup(c("priority"), PRIORITY_RANK, 2), lookup(c("source"), CARD_SOURCE_RANK, 4), lookup(c("trust"), TRUST_RANK, 4), "place", "finding", "file")
    score = lookup(c("priority"), {"p0": 100, "p1": 80}, 50) + F.when(c("source").isin("doctor", "issue"), 20).otherwise(0) + F.floor(c("strength") / 5 + 0.5) + lookup(c("trust"), TRUST_DELTA, 0)
    level = F.when(c("strength") >= 75, "strong").when(c("strength") >= 40, "moderate").otherwise("thin")
    return rows.select(by, "place", "strength", level.alias("level"), F.row_number().over(order).alias("rank"), score.cast("long").alias("score"))


def classify_feedback(text: Column) -> Column:
    """The first category of FEEDBACK all of whose patterns a text fits in lower case; a null text has none."""
    label = F.when(F.lit(False), None)
    for category, *patterns in FEEDBACK:
        label = label.when(reduce(lambda a, b: a & b, [F.lower(text).rlike(p) for p in patterns]), category)
    return label.when(text.isNotNull(), "uncategorized")
