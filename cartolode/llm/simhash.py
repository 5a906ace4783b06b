"""SimHash near-duplicates: 64-bit fingerprints linked within a Hamming radius by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, small, table
from .components import connected_components

BITS, RADIUS, SEED = 64, 3, 42
#: Buckets with more fingerprints are dealt out within themselves by further sets of masks, up to so many.
BUCKET, DEALS = 2048, 5
#: The bits of each byte value, and where the counts of each byte of a hash begin.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_COLUMN = np.arange(8) << 8


def covering_masks(bits: list[int], radius: int, turn: int = 0) -> list[int]:
    """Masks over the given bits such that any radius of them escape some mask together.

    Bit i gets a non-zero vector m(i) of radius + 1 binary digits, the vectors being dealt out evenly. For each non-zero
    v, the mask keeps the bits with odd <m(i), v>. The equations <m(i), v> = 0 for up to radius differing bits have a
    common non-zero v, and under its mask both values are the same.
    """
    count = (1 << (radius + 1)) - 1
    vector = {b: (k + turn) % count + 1 for k, b in enumerate(bits)}
    return [sum(1 << b for b in bits if (vector[b] & v).bit_count() % 2) for v in range(1, count + 1)]


def fingerprint(text: bytes | None, words_per_shingle: int = 3) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - words_per_shingle + 1)
    parts = map(b" ".join, zip(*(words[k:] for k in range(words_per_shingle)))) if len(words) >= words_per_shingle else iter([b" ".join(words)])
    digest, counts = xxhash.xxh64_intdigest, np.zeros((8, 256), np.int64)
    for at in range(0, n, 1 << 16):
        h = np.fromiter((digest(s, SEED) for s in islice(parts, 1 << 16)), np.uint64, min(1 << 16, n - at))
        counts += np.bincount((h.view(np.uint8).reshape(-1, 8) + _COLUMN).ravel(), minlength=2048).reshape(8, 256)
    return int(np.packbits(2 * (counts @ _BITS).ravel() > n, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        values = [fingerprint(t.as_py()) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("t"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    p = parent[x]
    while True:
        q = parent[p]
        if (q == p).all():
            return p
        p = q


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        a, b = _roots(parent, a), _roots(parent, b)
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def _forest(bucket: np.ndarray, fp: np.ndarray, radius: int) -> pa.RecordBatch:
    """A spanning forest of the links within buckets, which are whole and in order."""
    fps, node = np.unique(fp, return_inverse=True)
    value, parent = fps.view(np.uint64)[node], np.arange(len(fps))
    left, step = np.arange(len(node)), 1
    while len(left := left[left < len(node) - step]):
        left = left[bucket[left] == bucket[left + step]]
        near = left[np.bitwise_count(value[left] ^ value[left + step]) <= radius]
        _union(parent, node[near], node[near + step])
        step += 1
    root = _roots(parent, np.arange(len(fps)))
    held = root != np.arange(len(fps))
    return pa.RecordBatch.from_arrays([pa.array(fps[held]), pa.array(fps[root[held]])], ["a", "b"])


def _spanning(radius: int):
    """Compare the fingerprints within each bucket. Rows arrive in order of their buckets; a task holds one batch and the
    bucket that the one before left unfinished."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            bucket, fp = (np.concatenate([old, b.column(k).to_numpy()]) for k, old in (("bucket", bucket), ("fp", fp)))
            whole = np.searchsorted(bucket, bucket[-1]) if len(bucket) else 0
            if whole:
                yield _forest(bucket[:whole], fp[:whole], radius)
                bucket, fp = bucket[whole:], fp[whole:]
        if len(bucket):
            yield _forest(bucket, fp, radius)

    return links


def _buckets(fps: DataFrame, masks: list[int]) -> DataFrame:
    """A row for each table and fingerprint; the bucket is the masked value's 64-bit hash with the table's number.

    Two masked values that should collide always do; others may by chance, and the comparison sorts those out.
    """
    tables = [F.xxhash64(*([F.col("bucket")] if "bucket" in fps.columns else []), F.lit(t), F.col("fp").bitwiseAND(F.lit(signed(m)))) for t, m in enumerate(masks)]
    return fps.select("fp", F.explode(F.array(*tables)).alias("bucket"))


def near_links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints fps(fp) within radius bits, directly or through others.

    Every pair within the radius shares a bucket; each bucket yields at most its size in links. Buckets of more than
    `bucket` fingerprints are dealt out within themselves by further masks, over the bits in another order, which cover
    every pair of theirs again, so that nothing is lost. Each deal halves the bits in which a bucket's fingerprints can
    differ, or nearly so: after the last of DEALS they have some two bits left, and a bucket some four fingerprints.
    """
    dealt, done = _buckets(fps, covering_masks(list(range(BITS)), radius)), []
    for turn in range(1, DEALS):
        crowded = save(dealt.groupBy("bucket").count().where(F.col("count") > bucket).select("bucket"), "crowded")
        if not crowded.limit(1).count():
            break
        hot = small(crowded)
        done.append(dealt.join(hot, "bucket", "left_anti"))
        stride = (11, 23, 37, 51)[turn - 1]
        again = covering_masks([(stride * b) % BITS for b in range(BITS)], radius, 7 * turn)
        dealt = save(_buckets(dealt.join(hot, "bucket", "left_semi"), again), "dealt")
    for part in done:
        dealt = dealt.unionByName(part)
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_spanning(radius), "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per document: (doc_id, fingerprint, component_id); component_id is the smallest doc_id reachable by links.

    Null and empty texts have fingerprint zero and link like any others; rows that repeat share a component; a null id
    is no candidate for component_id, which is null if its whole component has none; an empty table gives no rows.
    """
    prints = save(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = save(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = save(connected_components(near_links(classes.select("fp"), radius)), "roots")
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("component", "fp"))
    rooted = save(rooted.select("fp", "root", "least"), "rooted")
    least = save(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = save(rooted.join(least, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash_covering(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
