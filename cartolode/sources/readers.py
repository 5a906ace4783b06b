"""Readers of repository artefacts into fact tables, and the append-only ledger."""

from __future__ import annotations

import posixpath
import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolode.functions.scalar import redact_secrets
from cartolode.sources.listing import IGNORED, list_files
from cartolode.sources.tables import exists, save

LEDGER = "command string, exit_code int, completed_at timestamp, started_at timestamp, duration_ms long, schema_version int, _corrupt_record string"


def read_git_log(spark: SparkSession, path: str) -> DataFrame:
    """Log text of `COMMIT|hash|email|epoch` heads, each followed by file names: (commit_hash, author, ts, path)."""
    blocks = spark.read.option("lineSep", "COMMIT|").text(path).where(F.trim("value") != "")
    lines = blocks.select(F.split("value", "\n").alias("lines"))
    head = F.split(F.col("lines")[0], r"\|")
    rows = lines.select(head[0].alias("commit_hash"), F.lower(head[1]).alias("author"), F.timestamp_seconds(F.trim(head[2]).cast("long")).alias("ts"), F.explode(F.slice("lines", 2, 1_000_000)).alias("path"))
    return rows.withColumn("path", F.regexp_replace(F.trim("path"), r"\\", "/")).where("path <> ''")


def read_lcov(spark: SparkSession, path: str) -> DataFrame:
    """LCOV records: (path, lines_found, lines_hit, pct); records without a file are dropped."""
    blocks = spark.read.option("lineSep", "end_of_record").text(path)
    number = lambda key: F.coalesce(F.regexp_extract("value", rf"(?m)^{key}:(\d+)", 1).try_cast("long"), F.lit(0))
    rows = blocks.select(F.trim(F.regexp_extract("value", r"(?m)^SF:(.*)$", 1)).alias("path"), number("LF").alias("lines_found"), number("LH").alias("lines_hit"))
    pct = F.when(F.col("lines_found") > 0, 100 * F.col("lines_hit") / F.col("lines_found")).otherwise(0.0)
    return rows.where("path <> ''").withColumn("pct", pct)


def read_coverage_summary(spark: SparkSession, path: str) -> DataFrame:
    """Coverage summaries as JSON maps of path to lines: (path, lines_found, lines_hit, pct), without the total."""
    kind = "map<string, struct<lines: struct<total: bigint, covered: bigint, pct: double>>>"
    rows = spark.read.option("wholetext", "true").text(path).select(F.explode(F.from_json("value", kind)).alias("path", "x")).where("path <> 'total'")
    found, hit = F.col("x.lines.total"), F.col("x.lines.covered")
    return rows.select("path", found.alias("lines_found"), hit.alias("lines_hit"), F.coalesce("x.lines.pct", F.when(found > 0, 100 * hit / found), F.lit(0.0)).alias("pct"))


def read_codeowners(spark: SparkSession, path: str) -> DataFrame:
    """Ownership rules in file order: (rule_no, pattern, regex, owner); later rules win."""
    lines = spark.read.option("wholetext", "true").text(path).select(F.posexplode(F.split("value", "\n")).alias("rule_no", "line"))
    rows = lines.withColumn("line", F.trim(F.regexp_replace("line", "#.*$", ""))).where(F.col("line").rlike(r"\S\s+\S"))
    parts = F.split("line", r"\s+")
    pattern = F.regexp_replace(parts[0], "^/", "")
    regex = F.regexp_replace(F.regexp_replace(F.regexp_replace(pattern, r"([.+^${}()|\[\]\\])", r"\\$1"), r"\*\*", "\u0000"), r"\*", "[^/]*")
    regex = F.concat(F.lit("^"), F.replace(regex, F.lit("\u0000"), F.lit(".*")), F.when(pattern.endswith("/"), ".*").otherwise("(/.*)?$"))
    return rows.select("rule_no", parts[0].alias("pattern"), regex.alias("regex"), parts[1].alias("owner"))


def read_ledger(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """Ledger rows of the schema version; malformed rows are dropped."""
    rows = spark.read.schema(LEDGER).option("mode", "PERMISSIVE").json(path)
    return rows.where("_corrupt_record is null and command is not null").where(F.col("schema_version") == version).drop("_corrupt_record")


def append_ledger(records: DataFrame, path: str, version: int = 1) -> None:
    """Append records(command, exit_code, completed_at, duration_ms) with secrets in commands redacted and started_at, which is the
    duration before completed_at."""
    started = F.timestamp_millis(F.unix_millis("completed_at") - F.col("duration_ms"))
    rows = records.withColumn("command", redact_secrets(F.col("command"))).withColumn("started_at", started)
    rows.withColumn("schema_version", F.lit(version)).write.mode("append").json(path)


def write_snapshot(df: DataFrame, path: str, version: int = 1) -> None:
    """Facts by repository and snapshot, partitioned so that either is pruned when read."""
    df.withColumn("schema_version", F.lit(version)).write.mode("append").partitionBy("repo", "snapshot").parquet(path)


def read_snapshot(spark: SparkSession, path: str, version: int = 1, schema: str = "repo string, snapshot string") -> DataFrame:
    """The facts below path of the schema version; none, with the given schema, where nothing was written yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path).where(F.col("schema_version") == version).drop("schema_version")


def _json_files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(manifest, x) for each JSON file; x is null for files that are no such JSON."""
    rows = spark.read.option("wholetext", "true").text(path)
    return rows.select(F.regexp_extract("_metadata.file_path", "[^/]*$", 0).alias("manifest"), F.from_json("value", kind).alias("x"))


def read_coverage_final(spark: SparkSession, path: str) -> DataFrame:
    """Statement counters as JSON maps of path to counts: (path, lines_found, lines_hit, pct); a statement is hit if it ran once."""
    rows = _json_files(spark, path, "map<string, struct<s: map<string, bigint>>>").select(F.explode("x").alias("path", "c"))
    found, hit = F.size("c.s"), F.size(F.map_filter("c.s", lambda k, v: v > 0))
    rows = rows.where("c.s is not null").select("path", found.cast("long").alias("lines_found"), hit.cast("long").alias("lines_hit"))
    return rows.withColumn("pct", F.when(F.col("lines_found") > 0, 100 * F.col("lines_hit") / F.col("lines_found")).otherwise(0.0))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Package manifests: (manifest, kind, name, value) for every dependency, development dependency and script."""
    kinds = ("dependencies", "devDependencies", "scripts")
    rows = _json_files(spark, path, "struct<" + ", ".join(f"{k}: map<string, string>" for k in kinds) + ">")
    each = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"x.{k}").alias("m")) for k in kinds]), lambda e: e["m"].isNotNull())
    return rows.select("manifest", F.inline(each)).select("manifest", "kind", F.explode("m").alias("name", "value"))


#: Fields of a package manifest that name its entry points.
ENTRY_FIELDS = "main module types typings browser exports bin".split()


def read_entrypoints(spark: SparkSession, path: str) -> DataFrame:
    """Entry points of package manifests: (manifest, name, value), name being the field and, where it holds an object, the keys
    below it, joined by `#`; what is no text is left out. Manifests that are no JSON have none."""
    rows = spark.read.option("wholetext", "true").text(path).select(F.regexp_extract("_metadata.file_path", "[^/]*$", 0).alias("manifest"), F.try_parse_json("value").alias("v"))
    level = rows.where("v is not null").select("manifest", F.lit("").alias("name"), "v")
    found = []
    for depth in range(4):
        inner = level.alias("l").lateralJoin(spark.tvf.variant_explode(F.col("l.v").outer()).alias("e"))
        named = F.col("e.key") if depth == 0 else F.concat("l.name", F.lit("#"), "e.key")
        level = inner.where("e.key is not null").select("l.manifest", named.alias("name"), F.col("e.value").alias("v"))
        level = level.where(F.col("name").isin(*ENTRY_FIELDS)) if depth == 0 else level
        found.append(level.where(F.schema_of_variant("v") == "STRING").select("manifest", "name", F.try_variant_get("v", "$", "string").alias("value")))
    return reduce(DataFrame.unionByName, found)


def read_lockfiles(spark: SparkSession, path: str) -> DataFrame:
    """Lockfiles with a map of install path to package: (manifest, name, version); the root entry is left out."""
    rows = _json_files(spark, path, "struct<packages: map<string, struct<version: string>>>").select("manifest", F.explode("x.packages").alias("at", "p"))
    return rows.where("at <> ''").select("manifest", F.substring_index("at", "node_modules/", -1).alias("name"), F.col("p.version").alias("version"))


def _plain(uri: str) -> str:
    """An address as Spark gives it, decoded, local ones with three slashes."""
    return re.sub("^file:/+", "file:///", unquote(uri))


def _included(root: str, source: str, line: str) -> tuple[str, str] | None:
    """The file that a line of a requirements file includes, below root, and whether as requirements or constraints."""
    m = re.match(r"""(-r|-c|--requirement(?=[\s=])|--constraint(?=[\s=]))\s*=?\s*(?:(['"])(.*?)\2(?:\s|$)|([^\s-]\S*))""", line)
    target = m and (m[3] or m[4])
    if not target or target.startswith("/") or re.match(r"[A-Za-z][A-Za-z+.-]*:", target):
        return None
    store, at = re.fullmatch(r"(\w[\w+.-]*://[^/]*)?(.*)", source).groups("")
    path = store + posixpath.normpath(posixpath.join(posixpath.dirname(at), target))
    return (path, "constraint" if m[1] in ("-c", "--constraint") else "requirement") if path.startswith(root.rstrip("/") + "/") else None


def read_requirements(spark: SparkSession, *paths: str, root: str | None = None) -> DataFrame:
    """Requirement lines: (name, specifier, pinned, source, kind); comments, blank lines and options are left out, names folded.

    Files that -r and -c lines include are read too, each once however often it is named and whether or not they include each
    other; kind is constraint for those reached by -c. A target that is absolute, an address, missing or outside root (by
    default the folder of the first file) is left out. The driver holds the names of files, no lines of requirements.
    """
    line = F.trim(F.regexp_replace("value", r"(^|\s)#.*$", ""))
    read = lambda files: spark.read.text(files).select(line.alias("l"), F.col("_metadata.file_path").alias("source")).where("l <> ''")
    first = sorted(map(_plain, spark.read.text(list(paths)).inputFiles()))
    if not first:
        return spark.createDataFrame([], "name string, specifier string, pinned string, source string, kind string")
    base = _plain(_address(spark, root)) if root else posixpath.dirname(first[0])
    kinds, todo, parts = {f: {"requirement"} for f in first}, first, []
    while todo:
        lines = save(read(todo), "requirements")
        parts.append(lines)
        todo = []
        for r in lines.where("startswith(l, '-')").distinct().collect():
            source = _plain(r["source"])
            if not (found := _included(base, source, r["l"])):
                continue
            target, kind = found
            new = {k if kind == "requirement" else "constraint" for k in kinds[source]}
            if target not in kinds and not exists(spark, target):
                continue
            if new - kinds.setdefault(target, set()):
                kinds[target] |= new
                todo.append(target)
        todo = sorted(set(todo))
    known = spark.createDataFrame([(f, k) for f, ks in kinds.items() for k in sorted(ks)], "source string, kind string")
    every = reduce(DataFrame.unionByName, parts).withColumn("source", F.regexp_replace(F.url_decode(F.replace("source", F.lit("+"), F.lit("%2B"))), "^file:/+", "file:///")).where("not startswith(l, '-')")
    part = lambda k: F.regexp_extract("l", r"^([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*([^;@]*)", k)
    rows = every.select(F.lower(F.regexp_replace(part(1), "[-_.]+", "-")).alias("name"), F.regexp_replace(part(2), r"\s+", "").alias("specifier"), "source").where("name <> ''").distinct()
    rows = rows.withColumn("pinned", F.nullif(F.regexp_extract("specifier", r"^===?([^,*]+)$", 1), F.lit("")))
    return rows.join(F.broadcast(known), "source").select("name", "specifier", "pinned", "source", "kind")


def _address(spark: SparkSession, path: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def scan_files(spark: SparkSession, root: str, ignore: list[str] = IGNORED, exts: tuple = ()) -> DataFrame:
    """Files below root: (path, dir, ext, size_bytes), hidden and empty ones included, ignored folders and files left out;
    contents are not read."""
    rows = list_files(spark, root, ignore=ignore)
    rows = rows.select("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), F.lower(F.regexp_extract("path", r"[^/.](\.[^./]+)$", 1)).alias("ext"), "size_bytes")
    return rows.where(F.col("ext").isin(*exts)) if exts else rows


#: The columns of session, telemetry and feedback events, for read and readStream alike.
EVENTS = "at timestamp, kind string, data map<string, string>, _corrupt_record string"


def read_events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """JSON lines of events (at, kind, data); malformed ones and those without a kind or time are dropped."""
    reader = (spark.readStream if streaming else spark.read).schema(EVENTS).option("mode", "PERMISSIVE")
    return reader.json(path).where("_corrupt_record is null and kind is not null and at is not null").drop("_corrupt_record")
