"""Reading tables, and written tables that cut the lineage of iterative operators."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; only a local session may do without it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df below the shared folder and read it back. What the write has shuffled is deleted with its end."""
    spark, path = df.sparkSession, f"{shared(df.sparkSession)}/cartolode-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of the tables that a wide shuffle deals to a partition, the bytes up to which small ones are put together, and those of
#: a table's file that a task reads.
TASK_ROWS, TASK_BYTES, READ_BYTES = 100_000, "4m", "8m"


@contextmanager
def wide(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside shuffles into as many partitions as so many rows ask for, so that what a task holds does not grow with
    the tables. What is only planned inside and runs later does not."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], str(max(int(before[0]), -(-rows // TASK_ROWS))))
    spark.conf.set(names[1], TASK_BYTES)
    spark.conf.set(names[2], READ_BYTES)
    try:
        yield
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)


def sized(spark: SparkSession, sf_dir: str, tables: tuple, made: Callable[[], DataFrame]) -> DataFrame:
    """made(), run in shuffles as wide as the rows of the tables ask for, and written."""
    with wide(spark, sum(table(spark, sf_dir, t).count() for t in tables)):
        return save(made(), "sized")


def signature(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of the files below path, which changes when they do."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
    seen = []
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:32]


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
