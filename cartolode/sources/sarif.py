"""A sink of SARIF 2.1.0 logs: one document for each repository, written as a stream and committed by renaming."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
LOCATIONS = "array<struct<file:string,line:int,column:int,endLine:int,endColumn:int>>"


def level(severity: Column) -> Column:
    return F.when(severity == "error", "error").when(severity == "warning", "warning").otherwise("note")


def rule_name(rule: Column) -> Column:
    """`generic-secret` as `GenericSecret`."""
    parts = F.filter(F.split(rule, "[-_]"), lambda x: x != "")
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))), "")


def sarif_rules(issues: DataFrame) -> DataFrame:
    """(repo, rule_id, name, title, level) once a repository and rule; of titles the smallest counts, with its severity."""
    first = issues.groupBy("repo", "rule_id").agg(F.min(F.struct("title", "severity")).alias("x"))
    return first.select("repo", "rule_id", rule_name(F.col("rule_id")).alias("name"), F.col("x.title").alias("title"), level(F.col("x.severity")).alias("level"))


def sarif_lines(issues: DataFrame) -> DataFrame:
    """(repo, part, line): the JSON texts of a repository's rules (part 0) and results (part 1).

    issues(repo, rule_id, title, severity, category, locations) may have description and fix_id. A result without a location
    stands at the root, as the format's readers ask; a region needs a line; without a description the title is the message.
    """
    rules = sarif_rules(issues).select("repo", F.lit(0).alias("part"), F.to_json(F.struct(
        F.col("rule_id").alias("id"), "name", F.struct(F.col("title").alias("text")).alias("shortDescription"), F.struct("level").alias("defaultConfiguration"))).alias("line"))
    optional = {c: F.col(c) if c in issues.columns else F.lit(None).cast("string") for c in ("description", "fix_id")}
    given = F.col("locations").cast(LOCATIONS)
    places = F.when(F.size(given) > 0, given).otherwise(F.array(F.struct(F.lit(".").alias("file"), *[F.lit(None).cast("int").alias(c) for c in ("line", "column", "endLine", "endColumn")])).cast(LOCATIONS))
    region = lambda x: F.when(x["line"].isNotNull(), F.struct(x["line"].alias("startLine"), x["column"].alias("startColumn"), x["endLine"].alias("endLine"), x["endColumn"].alias("endColumn")))
    where = F.transform(places, lambda x: F.struct(F.struct(F.struct(F.translate(x["file"], "\\", "/").alias("uri")).alias("artifactLocation"), region(x).alias("region")).alias("physicalLocation")))
    fixed = F.when(optional["fix_id"].isNotNull(), True)
    results = issues.select("repo", F.lit(1).alias("part"), F.to_json(F.struct(
        F.col("rule_id").alias("ruleId"), level(F.col("severity")).alias("level"), F.struct(F.coalesce(F.nullif(optional["description"], F.lit("")), "title").alias("text")).alias("message"),
        where.alias("locations"), F.struct("category", fixed.alias("fixAvailable"), optional["fix_id"].alias("fixId")).alias("properties"))).alias("line"))
    return rules.unionByName(results)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # temporary and final names


class _Writer(DataSourceWriter):
    """Rows come in order of repository and part; a document is open at a time, so that a task holds a line."""

    def __init__(self, options: dict):
        self.path, self.tool, self.version = options["path"], options.get("tool", "cartolode"), options.get("version", "0")

    def _open(self):
        return pyarrow.fs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + self.path.removeprefix("file:"))

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        files, base = self._open()
        files.create_dir(base, recursive=True)
        driver = json.dumps({"name": self.tool, "version": self.version})[:-1]
        done, out, repo, part, empty = [], None, None, 0, True

        def close() -> None:
            if out is not None:
                out.write(b"]}]}" if part else b']}},"results":[]}]}')
                out.close()

        for row in iterator:
            if out is None or row["repo"] != repo:
                close()
                repo, part, empty = row["repo"], 0, True
                name = quote(str(repo), safe="") + ".sarif"
                done.append((f"{base}/.{name}.{uuid.uuid4().hex}", f"{base}/{name}"))
                out = files.open_output_stream(done[-1][0])
                out.write(f'{{"$schema":{json.dumps(SCHEMA)},"version":"2.1.0","runs":[{{"tool":{{"driver":{driver},"rules":['.encode())
            if row["part"] and not part:
                out.write(b']}},"results":[')
                part, empty = 1, True
            out.write(("" if empty else ",\n").encode() + row["line"].encode())
            empty = False
        close()
        return _Written(done)

    def commit(self, messages: list) -> None:
        files, _ = self._open()
        for m in messages:
            for temporary, final in m.files if m else ():
                files.move(temporary, final)

    def abort(self, messages: list) -> None:
        files, _ = self._open()
        for m in messages:
            for temporary, _ in m.files if m else ():
                files.delete_file(temporary)


class SarifSource(DataSource):
    """`df.write.format("sarif").option("path", folder)`: rows of sarif_lines(), together and in order by repository and part."""

    @classmethod
    def name(cls) -> str:
        return "sarif"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def write_sarif(issues: DataFrame, path: str, tool: str = "cartolode", version: str = "0") -> None:
    """A SARIF 2.1.0 document for each repository of issues, `<repo>.sarif` below path. Documents appear when all are written; one
    of an earlier run is replaced. A repository without issues has none."""
    issues.sparkSession.dataSource.register(SarifSource)
    ordered = sarif_lines(issues.where("repo is not null")).repartition("repo").sortWithinPartitions("repo", "part", "line")
    ordered.write.format("sarif").option("path", path).option("tool", tool).option("version", version).mode("append").save()
