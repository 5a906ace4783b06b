"""Facts of files, and edges between files, kept as changes come: buckets by path, versions of buckets, and a manifest a batch."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cartolode.sources.tables import exists, save

BUCKETS = 64
EDGES = "path string, target string, live boolean"


class FactStore:
    """Facts (path, ...) by the hash of their path, and edges (path, target, live) by the hash of their target, below root.

    extract(files(path, content)) gives the facts of files, and targets(facts) the files (path, target) that they point at,
    which need not be there: an edge is live while its target is. A batch rewrites the buckets that it touches, and no others,
    as a new version; the batch's manifest, which is put in place last and at once, says which version of each bucket holds. A
    batch that is run again reads the manifest before it and writes the same; readers see whole batches only. A file without
    facts is there if extract gives it a row, so extract should give one for each.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, extract: Callable[[DataFrame], DataFrame], targets: Callable[[DataFrame], DataFrame] | None = None, buckets: int = BUCKETS):
        self.spark, self.root, self.extract, self.targets, self.buckets = spark, root.rstrip("/"), extract, targets, buckets
        self.kinds = {"facts": StructType.fromDDL(schema), "edges": StructType.fromDDL(EDGES)}

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self, before: int | None = None) -> dict:
        """The last manifest, or the last before a batch: of facts and edges the version of each bucket that holds any."""
        at, files = self._fs(f"{self.root}/manifests")
        names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
        numbers = sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))
        numbers = [n for n in numbers if before is None or n < before]
        if not numbers:
            return {"facts": {}, "edges": {}}
        text = self.spark.read.option("wholetext", "true").text(f"{self.root}/manifests/{numbers[-1]:010}.json").first()[0]
        return json.loads(text)

    def _commit(self, number: int, manifest: dict) -> None:
        final, files = self._fs(f"{self.root}/manifests/{number:010}.json")
        temporary, _ = self._fs(f"{self.root}/manifests/.{number:010}.tmp")
        out = files.create(temporary, True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        if files.exists(final):
            files.delete(final, False)
        files.rename(temporary, final)

    def _bucket(self, column: Column | str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def read(self, kind: str = "facts", manifest: dict | None = None, only: set | None = None) -> DataFrame:
        """The facts or edges of a manifest, the last by default, of all buckets or of some."""
        held = (manifest or self.manifest())[kind]
        paths = [f"{self.root}/{kind}/version={v}/bucket={b}" for b, v in sorted(held.items()) if only is None or int(b) in only]
        return self.spark.read.schema(self.kinds[kind]).parquet(*paths) if paths else self.spark.createDataFrame([], self.kinds[kind])

    def edges(self) -> DataFrame:
        """(path, target) of the edges whose target is there."""
        return self.read("edges").where("live").select("path", "target")

    def _write(self, kind: str, rows: DataFrame, by: str, touched: set, number: int, manifest: dict) -> None:
        """Buckets are written by the tasks that their rows are dealt to; those left without rows leave the manifest."""
        out = f"{self.root}/{kind}/version={number}"
        rows.withColumn("bucket", self._bucket(by)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(out)
        for b in touched:
            manifest[kind].pop(str(b), None)
            if exists(self.spark, f"{out}/bucket={b}"):
                manifest[kind][str(b)] = number

    def _touched(self, rows: DataFrame, column: str) -> set:
        return {r[0] for r in rows.select(self._bucket(column)).distinct().collect()}

    def apply(self, changed: DataFrame, number: int) -> None:
        """Take in a batch of changed(path, content, at): of each path the latest change counts, of equal times the greatest
        content; a null content is a file that is gone. Null paths count for nothing."""
        old = self.manifest(number)
        new = {kind: dict(held) for kind, held in old.items()}
        last = changed.where("path is not null").groupBy("path").agg(F.max_by("content", F.struct("at", F.col("content").isNotNull(), "content")).alias("content"))
        last = save(last.withColumn("gone", F.col("content").isNull()), "changes")
        paths = last.select("path")
        mine = self._touched(paths, "path")
        if mine:
            fresh = save(self.extract(last.where("not gone").select("path", "content")).select(*self.kinds["facts"].names), "fresh")
            before = self.read("facts", old, mine)
            stale = save(before.join(paths, "path", "left_semi"), "stale")
            self._write("facts", before.join(paths, "path", "left_anti").unionByName(fresh), "path", mine, number, new)
            if self.targets:
                self._edges(last, paths, fresh, stale, mine, old, new, number)
        self._commit(number, new)

    def _edges(self, last: DataFrame, paths: DataFrame, fresh: DataFrame, stale: DataFrame, mine: set, old: dict, new: dict, number: int) -> None:
        """What changed files pointed at goes, what they point at now comes, and what others point at them for follows whether
        they are there: those buckets of the targets are read and written."""
        point = save(self.targets(fresh).select("path", "target").distinct(), "targets")
        asked = self._touched(point, "target")
        touched = asked | self._touched(self.targets(stale), "target") | mine
        # The facts of this batch are written, so that a look at them tells which of the new targets are there.
        there = self.read("facts", new, asked).select(F.col("path").alias("target")).distinct().withColumn("live", F.lit(True))
        come = point.join(there, "target", "left").select("path", "target", F.coalesce("live", F.lit(False)).alias("live"))
        kept = self.read("edges", old, touched).join(paths, "path", "left_anti")
        moved = last.select(F.col("path").alias("target"), (~F.col("gone")).alias("now"))
        kept = kept.join(moved, "target", "left").select("path", "target", F.coalesce("now", "live").alias("live"))
        self._write("edges", kept.unionByName(come), "target", touched, number, new)


def refresh_stream(changes: DataFrame, store: FactStore, checkpoint: str):
    """A query that applies each batch of changes(path, content, at) to a store. What a batch writes grows with the buckets that
    it touches, and a batch that is run again after a failure leaves the store as it was."""
    return changes.writeStream.foreachBatch(store.apply).option("checkpointLocation", checkpoint)
