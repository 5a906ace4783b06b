"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark; repeated windows merge into removal intervals.

A window is routed by its anchor, the least hash of the shorter grams in it: neighbouring windows mostly share one, so that a
shuffled row carries the hashes of all windows of a stretch and no row stands for a single window. Equal windows have equal
anchors, so they meet in one partition, where windows whose anchor occurs once are put aside before the rest are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save, table, text_batches

WIDTH, GRAM = 20, 10
#: Bytes of text that a task holds at once; repeats within them are settled before anything is shuffled.
PIECE = 8 << 20
#: Documents that are looked at for anchors so common that their windows go by their own hashes; the share of those documents
#: that makes an anchor common. This decides on routing alone: every window is counted whichever way it goes.
SAMPLE, COMMON = 5_000, 0.01
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNDO = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
ROW = "key long, doc_id long, row long, start int, gone int, hashes array<long>"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Rolling:
    """Rabin-Karp hashes modulo 2^64 of all grams of a sequence of hashes, of any length, from one pass of prefix sums."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]), dtype=np.uint64)
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), _UNDO)]), dtype=np.uint64)[:n]
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(ids * down, dtype=np.uint64)])

    def grams(self, width: int) -> np.ndarray:
        n = max(len(self.sums) - width, 0)
        return mixed((self.sums[width:] - self.sums[:n]) * self.up[width - 1 : width - 1 + n]) if n else np.zeros(0, np.uint64)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the leftmost least value of each window."""
    return np.lib.stride_tricks.sliding_window_view(values, width).argmin(axis=1) + np.arange(len(values) - width + 1)


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values.view(np.int64), pa.int64()))


def _windows(texts: list, width: int, gram: int):
    """Of all windows of the texts: the text's number, the first word's number in it, the window's hash, its anchor's hash
    and an anchor's number."""
    known, words = _Hashes(), []
    for t in texts:
        words.append([known[w] for w in t.split()])
    n = np.array([len(w) for w in words], np.int64)
    ids = np.fromiter((h for w in words for h in w), np.uint64, n.sum())
    if len(ids) < width:
        return None
    begin = np.repeat(np.cumsum(n) - n, n)
    text = np.repeat(np.arange(len(n)), n)
    rolling = Rolling(ids)
    whole = text[: len(ids) - width + 1] == text[width - 1 :]
    grams = rolling.grams(gram)
    anchor = least(grams, width - gram + 1)[whole]
    at = np.flatnonzero(whole)
    return text[at], at - begin[at], rolling.grams(width)[at], grams[anchor], anchor


def _stretches(width: int, gram: int, common: np.ndarray):
    """Rows of ROW: stretches of windows that share an anchor, and intervals that repeats within the piece settle."""

    def piece(ids: list, rows: list, texts: list) -> pa.RecordBatch | None:
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
        found = _windows([texts[k] for k in order], width, gram)
        if found is None:
            return None
        text, start, h, anchor, place = found
        doc = [ids[k] for k in order]
        rank = np.cumsum([0] + [a != b for a, b in zip(doc[1:], doc)])[text]  # texts that share an id share a rank
        sort = np.argsort(h, kind="stable")
        same = (h[sort][1:] == h[sort][:-1]) & (anchor[sort][1:] == anchor[sort][:-1])
        first = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(sort)), 0))
        later = rank[sort] > rank[sort][first]
        later[1:] |= same & (text[sort][1:] == text[sort][:-1])
        gone = np.zeros(len(h), bool)
        gone[sort[later]] = True
        alone = np.isin(anchor, common) & ~gone
        joins = (text[1:] == text[:-1]) & (start[1:] == start[:-1] + 1) & (gone[1:] == gone[:-1])
        joins &= gone[1:] | (place[1:] == place[:-1]) & ~alone[1:]
        head = np.flatnonzero(np.concatenate([[True], ~joins]))
        size = np.diff(np.append(head, len(h)))
        kept = np.where(gone[head], 0, size)
        row = np.array([rows[k] for k in order], np.int64)[text[head]]
        key = np.where(gone[head], row.view(np.uint64), np.where(alone[head], mixed(anchor[head] ^ h[head]), anchor[head]))
        by = pa.array(doc, pa.int64()).take(pa.array(text[head]))
        return pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), by, pa.array(row), pa.array(start[head], pa.int32()), pa.array(size - kept, pa.int32()), _lists(h[~gone], np.cumsum(kept))],
            ["key", "doc_id", "row", "start", "gone", "hashes"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, texts, held = [], [], [], 0
        for b in batches:
            for i, r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                t = t.as_buffer().to_pybytes() if t.is_valid else b""
                ids.append(i), rows.append(r), texts.append(t)
                held += len(t)
                if held >= PIECE:
                    if (out := piece(ids, rows, texts)) is not None:
                        yield out
                    ids, rows, texts, held = [], [], [], 0
        if texts and (out := piece(ids, rows, texts)) is not None:
            yield out

    return run


def _anchors(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = _windows([t.as_buffer().to_pybytes() if t.is_valid else b"" for t in b.column(0)], width, gram)
            if found is not None:
                head = np.flatnonzero(np.concatenate([[True], found[4][1:] != found[4][:-1]]))
                text, anchor = found[0][head], found[3][head]
                sort = np.lexsort((anchor, text))
                text, anchor = text[sort], anchor[sort]
                new = np.concatenate([[True], (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1])])
                anchors, n = np.unique(anchor[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(n)], ["anchor", "n"])

    return run


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _cut(width: int):
    """(doc_id, n_words, n_removed, spans, kept): marks are windows to go, as a first one with a bit for each of those
    that follow it, or with how many go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [t.as_buffer().to_pybytes().split() if t.is_valid else [] for t in b.column(1)]
            begin = np.cumsum([0] + [len(w) for w in words])
            step = np.zeros(begin[-1] + 1, np.int64)
            marks = b.column(2)
            each = marks.flatten()
            start, gone, bits = (each.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            start = start + np.repeat(begin[:-1], [len(m) if m.is_valid else 0 for m in marks])
            for first, last in ((start[gone > 0], (start + gone)[gone > 0]), *((start[x] + k, start[x] + k + 1) for k in range(64) if (x := (bits >> k) & 1 == 1).any())):
                np.add.at(step, first, 1)
                np.add.at(step, last + width - 1, -1)
            cut = np.cumsum(step)[:-1] > 0
            spans, kept = [], []
            for k, w in enumerate(words):
                c = cut[begin[k] : begin[k + 1]]
                edge = np.diff(np.concatenate([[0], c.astype(np.int8), [0]]))
                spans.append([{"start": s, "end": e} for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())])
                kept.append(b" ".join(x for x, y in zip(w, c) if not y) if spans[-1] else b" ".join(w))
            removed = [sum(s["end"] - s["start"] for s in x) for x in spans]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(begin)), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(SPAN)), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "spans", "kept"],
            )

    return run


def common_anchors(docs: DataFrame, width: int, gram: int) -> np.ndarray:
    """Anchors that over COMMON of SAMPLE documents, drawn by a hash, hold. There are at most 1 / COMMON times the anchors of
    one document of them."""
    n = docs.count()
    drawn = docs.where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, SAMPLE / max(n, 1)))))
    counted = drawn.select("text").mapInArrow(_anchors(width, gram), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") > max(50, COMMON * min(n, SAMPLE))).select("anchor").toPandas()["anchor"]
    return np.sort(found.to_numpy(np.int64).view(np.uint64))


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per document: (doc_id, n_words, n_removed, spans, kept). spans are the maximal intervals of words, end
    exclusive, covered by windows of width words that also start earlier: in a document of smaller id, or before in the
    same one. kept is the other words, joined by one space.

    Null and empty texts have no words; texts shorter than a window keep all. Null ids come after all others. Rows that
    share an id, null or not, are no earlier than each other, so copies under one id cut nothing from one another. An empty
    table gives no rows; other columns are ignored.
    """
    if not 2 <= width <= 120:
        raise ValueError("a window has 2 to 120 words")
    spark, gram = documents.sparkSession, width // 2
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col).cast("long"), text_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    with text_batches(spark):
        common = common_anchors(docs, width, gram)
        found = docs.mapInArrow(_stretches(width, gram, common), ROW)
        by_key = found.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1 or gone > 0").drop("n")
        each = by_key.select("key", "doc_id", "row", "start", "gone", F.posexplode_outer("hashes").alias("at", "h"))
        each = each.withColumn("least", F.min("doc_id").over(Window.partitionBy("key", "h")))
        late = F.coalesce(F.col("doc_id") > F.col("least"), F.col("least").isNotNull()) & F.col("h").isNotNull()
        bits = F.bit_or(F.when(late, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at"))).otherwise(F.lit(0).cast("long")))
        marked = each.where(late | (F.col("gone") > 0)).groupBy("key", "doc_id", "row", "start", "gone").agg(bits.alias("bits"))
        marks = save(marked.select("doc_id", "row", "start", "gone", "bits"), "marks")
        of_row = marks.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "gone", "bits")).alias("marks"))
        on = docs["doc_id"].eqNullSafe(of_row["doc_id"]) & (docs["row"] == of_row["row"])
        joined = docs.join(of_row.hint("shuffle_hash"), on, "left").select(docs["doc_id"], "text", "marks")
        out = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string"
        return save(joined.mapInArrow(_cut(width), out), "kept")


def op12_substring_dedup(spark, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS k FROM s),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM h),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r WHERE n > 1),
g AS (SELECT doc_id, list(p) AS gone, count(*) AS n FROM x GROUP BY doc_id),
m AS (SELECT doc_id, map_from_entries(list((p, true))) AS cut FROM x GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN m.cut IS NULL THEN w ELSE
    list_filter(w, lambda v, k: NOT coalesce(cut[k], false)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN m USING (doc_id)
"""
