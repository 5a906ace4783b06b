"""Shared helpers: written tables that cut lineage, size-checked broadcasts, table reading."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words in every contract: space and the control characters tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: A side is broadcast only when its counted rows, and the bytes of the strings in them, stay at or below these.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    kept = spark.sparkContext.getCheckpointDir()
    if kept:
        return kept.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, always with its scheme, so that Python tasks can open it through pyarrow.fs."""
    path = f"{shared_dir(spark)}/cartolode-{name}-{uuid.uuid4().hex}"
    return path if "://" in path else "file://" + path.removeprefix("file:")


def make_dir(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(jpath)


def remove_dir(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


@contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the plan that follows starts from files and survives lost executors. What
    the write has shuffled is deleted with its end, not when the driver comes to collect its garbage."""
    path = new_path(df.sparkSession, name)
    with _set(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def text_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What runs inside hands rows to Python in smaller batches, for rows that are whole texts, of which a task holds a batch."""
    with _set(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)):
        yield


def trimmed(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """task, for mapInArrow, which gives what it has freed back to the system when it ends: workers serve one stage after another
    and would otherwise keep what the largest of them took."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return run


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if its counted rows and the counted bytes of its strings are within the bounds; else as it is,
    and the join shuffles."""
    wide = [F.octet_length(c.name) for c in df.schema.fields if c.dataType.typeName() in ("string", "binary")]
    n, held = df.limit(rows + 1).agg(F.count("*"), F.sum(sum((F.coalesce(w, F.lit(0)) for w in wide), F.lit(0)))).first()
    return F.broadcast(df) if n <= rows and (held or 0) <= size else df


def lower_ascii(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo by; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by
