"""Listing folders as a Spark job: a round for each level, folders dealt to tasks, hidden and empty files included."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolode.sources.tables import save

#: Folders and files that are left out, a star standing for any beginning.
IGNORED = (
    "node_modules .git dist build coverage .next .nuxt .cache .turbo .output .DS_Store Thumbs.db "
    "venv .venv env __pycache__ .tox .pytest_cache .mypy_cache .ruff_cache .eggs *.egg-info"
).split()
#: Folders that one task lists.
FOLDERS = 64


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each folder, a root and a path below it, holds: (root, path, folder, size_bytes)."""
    for b in batches:
        rows = []
        for root, folder in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            files, base = pyarrow.fs.FileSystem.from_uri(root)
            at = f"{base.rstrip('/')}/{folder}".rstrip("/") or "/"
            for x in files.get_file_info(pyarrow.fs.FileSelector(at, allow_not_found=True)):
                if x.type != pyarrow.fs.FileType.NotFound:
                    rows.append((root, f"{folder}/{x.base_name}".lstrip("/"), x.type == pyarrow.fs.FileType.Directory, x.size if x.is_file else None))
        kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(4)], ["root", "path", "folder", "size_bytes"])


def ignored(name: Column, patterns: list[str]) -> Column:
    whole = [p for p in patterns if not p.startswith("*")]
    return reduce(lambda a, p: a | name.endswith(p[1:]), [p for p in patterns if p.startswith("*")], name.isin(*whole))


def list_files(spark: SparkSession, *roots: str, ignore: list[str] = IGNORED) -> DataFrame:
    """(root, path, size_bytes) of every file below the roots, paths relative to theirs; ignored folders are not entered. Roots
    are addresses that pyarrow reads, or local folders; a root that is not there has no files.

    Each round lists the folders that the one before found, FOLDERS to a task, and is a written table, so that the driver
    holds no listing. Links are followed as the file system does.
    """
    uris = [(r if "://" in r else "file://" + r.removeprefix("file:"), "") for r in roots]
    folders, found = spark.createDataFrame(uris, "root string, path string"), []
    left = len(uris)
    while left:
        dealt = folders.repartition(-(-left // FOLDERS))
        listed = save(dealt.mapInArrow(_entries, "root string, path string, folder boolean, size_bytes long").where(~ignored(F.substring_index("path", "/", -1), ignore)), "listed")
        found.append(listed.where("not folder").select("root", "path", "size_bytes"))
        folders = listed.where("folder").select("root", "path")
        left = folders.count()
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "root string, path string, size_bytes long")
