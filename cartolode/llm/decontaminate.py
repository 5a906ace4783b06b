"""Benchmark decontamination: q-gram lemma filtering over diagonal bands, verified by banded alignment."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chargrams import grams, normalise
from .common import save, small, table

Q, MAX_ERROR = 8, 0.1
#: Benchmark characters that one broadcast index holds; larger benchmarks are matched in blocks of this size.
BLOCK_CHARS = 8_000_000
HITS = "doc_id long, rep long, start long, end long, distance int"


def budget(length: int, q: int, max_error: float) -> tuple[int, int]:
    """(edits, gram length) for an item of so many characters: a tenth or so of it, and grams of q, or shorter ones where
    else the lemma would ask for none."""
    edits = int(max_error * length)
    return edits, min(q, length // (edits + 1))


def item_codes(text: str | None, max_error: float) -> np.ndarray:
    """Folded code points from the first word to the last. An item that is too short for any edit gets a blank on both
    sides, so that it matches whole words only."""
    codes = normalise(text)[0]
    codes = codes[int(len(codes) > 0 and codes[0] == 32) :]
    codes = codes[: len(codes) - int(len(codes) > 0 and codes[-1] == 32)]
    return np.concatenate([[32], codes, [32]]).astype(np.uint32) if len(codes) and not int(max_error * len(codes)) else codes


class Index:
    """Benchmark items that take grams of one length: the grams in sorted order with their items and positions, and a bit
    table to pass over others."""

    def __init__(self, items: list[tuple[int, np.ndarray]], q: int, max_error: float):
        self.q, self.ids, self.codes, found, item, pos, kept = q, [], [], [], [], [], []
        self.errors, self.need = [], []
        for item_id, codes in items:
            errors = budget(len(codes) - 2 * int(codes[0] == 32), q, max_error)[0]
            g = grams(codes, q)
            found.append(g)
            item.append(np.full(len(g), len(self.ids)))
            pos.append(np.arange(len(g)))
            kept.append(len(g) - (len(g) - q * errors) // 2)
            self.ids.append(item_id)
            self.codes.append(codes)
            self.errors.append(errors)
            self.need.append(kept[-1] - q * errors)
        self.errors, self.need = np.array(self.errors, np.int64), np.array(self.need, np.int64)
        self.length = np.array([len(c) for c in self.codes], np.int64)
        g, item, pos = np.concatenate(found), np.concatenate(item), np.concatenate(pos)
        # Of an item's q-grams, any r may be left out if r fewer are then asked for: half the slack goes to the commonest.
        _, which, often = np.unique(g, return_inverse=True, return_counts=True)
        order = np.lexsort((pos, often[which], item))
        place = np.arange(len(g)) - np.searchsorted(item[order], item[order])
        order = order[place < np.array(kept, np.int64)[item[order]]]
        order = order[np.argsort(g[order], kind="stable")]
        g, self.item, self.pos = g[order], item[order], pos[order]
        self.gram, self.first = np.unique(g, return_index=True)
        self.count = np.diff(np.append(self.first, len(g)))
        self.bits = np.zeros(1 << 21, bool)
        self.bits[(self.gram >> np.uint64(43)).astype(np.int64)] = True

    def search(self, codes: np.ndarray, piece: int = 1 << 12) -> Iterator[tuple[int, int, int, int]]:
        """(item, start, end, distance) of the regions found in a padded text, some of them more than once."""
        h = grams(codes, self.q)
        # Pieces overlap by the longest item with its edits, so that a region lies whole in one of them.
        overlap = int((self.length + 2 * self.errors).max()) + self.q
        for begin in range(0, max(1, len(h)), piece):
            for i, *rest in self._piece(codes, h[begin : begin + piece + overlap], begin):
                yield self.ids[i], *rest

    def _piece(self, codes: np.ndarray, h: np.ndarray, begin: int) -> Iterator[tuple[int, int, int, int]]:
        seen = np.flatnonzero(self.bits[(h >> np.uint64(43)).astype(np.int64)])
        k = np.searchsorted(self.gram, h[seen])
        k[k == len(self.gram)] = 0
        same = self.gram[k] == h[seen]
        seen, k = seen[same], k[same]
        n = self.count[k]
        if not len(n):
            return
        entry = np.repeat(self.first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
        item = self.item[entry]
        plenty = (np.bincount(item, minlength=len(self.need)) >= self.need)[item]
        if not plenty.any():
            return
        entry, item = entry[plenty], item[plenty]
        diagonal = np.repeat(seen + begin, n)[plenty] - self.pos[entry]
        # A match with e edits keeps to e+1 neighbouring diagonals: bands of 2e+2 that overlap by half hold it whole.
        half = self.errors[item] + 1
        band = diagonal // half
        low = int(band.min()) - 1
        span = int(band.max()) - low + 2
        key = np.concatenate([item * span + band - low, item * span + band - 1 - low])
        order = np.argsort(key, kind="stable")
        keys, first, hits = np.unique(key[order], return_index=True, return_counts=True)
        for j in np.flatnonzero(hits >= self.need[keys // span]):
            i, b = int(keys[j] // span), int(keys[j] % span) + low
            own, e, m = order[first[j] : first[j] + hits[j]] % len(item), int(self.errors[i]), int(self.length[i])
            if self._shared(diagonal[own], self.pos[entry[own]], e) < self.need[i]:
                continue
            start = max(0, b * (e + 1) - e)
            stop = min(len(codes), (b + 2) * (e + 1) + m + e)
            for x in align(self.codes[i], codes[start:stop], e):
                yield i, start + x[0], start + x[1], x[2]

    @staticmethod
    def _shared(diagonal: np.ndarray, pos: np.ndarray, errors: int) -> int:
        """The most different q-gram positions of the item that any errors + 1 neighbouring diagonals hold."""
        order, most = np.argsort(diagonal), 0
        diagonal, pos = diagonal[order], pos[order]
        ends = np.searchsorted(diagonal, diagonal + errors, side="right")
        for begin in np.flatnonzero(np.diff(diagonal, prepend=diagonal[0] - 1)):
            if ends[begin] - begin > most:
                most = max(most, len(np.unique(pos[begin : ends[begin]])))
        return most


def align(item: np.ndarray, region: np.ndarray, errors: int) -> list[tuple[int, int, int]]:
    """(start, end, distance) of parts of region within so many edits of item: all that are equal to it, else the nearest.

    Rows of the edit-distance matrix go over the item's characters; the region is only as wide as its diagonal band.
    """
    m, w = len(item), len(region)
    if w < m - errors:
        return []
    data, wanted, same = region.tobytes(), item.tobytes(), []
    at = data.find(wanted)
    while at >= 0:
        if at % 4 == 0:
            same.append((at // 4, at // 4 + m, 0))
        at = data.find(wanted, at + 1)
    if same:
        return same
    if not errors:
        return []
    steps = np.arange(w + 1)
    cost, origin = np.zeros(w + 1, np.int64), steps.copy()
    for c in item:
        across, down = cost[:-1] + (region != c), cost[1:] + 1
        best = np.where(across <= down, across, down)
        new = np.concatenate([[cost[0] + 1], best])
        start = np.concatenate([[origin[0]], np.where(across <= down, origin[:-1], origin[1:])])
        # An insertion runs on from the cheapest cell to the left.
        lead = (new - steps) * (w + 2) + steps
        run = np.minimum.accumulate(lead)
        source = run % (w + 2)
        cost = new[source] + steps - source
        origin = start[source]
        if cost.min() > errors:
            return []
    end = int(cost.argmin())
    return [(int(origin[end]), end, int(cost[end]))] if cost[end] <= errors and end > origin[end] else []


class Matcher:
    """The indexes of one block of the benchmark, one for each gram length that its items take."""

    def __init__(self, items: list[tuple[int, str]], q: int, max_error: float):
        by_gram: dict[int, list] = {}
        for item_id, text in items:
            codes = item_codes(text, max_error)
            if len(codes):
                by_gram.setdefault(budget(len(codes), q, max_error)[1], []).append((item_id, codes))
        self.parts = [Index(part, k, max_error) for k, part in sorted(by_gram.items())]

    def search(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, start, end, distance) of all regions, those of an item apart from each other: of regions that overlap the
        nearest stays, the first of equals. Ends are exclusive, in code points of the text; blanks around do not count."""
        if not self.parts:
            return []
        codes, at = normalise(text)
        if not len(codes):
            return []
        lead, trail = int(codes[0] != 32), int(codes[-1] != 32)
        codes = np.concatenate([np.full(lead, 32, np.uint32), codes, np.full(trail, 32, np.uint32)])
        found: dict[int, set] = {}
        for part in self.parts:
            for i, s, e, d in part.search(codes):
                # The blanks at both ends are no part of the region.
                s, e = s + int(codes[s] == 32), e - int(codes[e - 1] == 32)
                if s < e:
                    found.setdefault(i, set()).add((d, int(at[s - lead]), int(at[e - 1 - lead]) + 1))
        out = []
        for i, regions in found.items():
            kept: list[tuple[int, int]] = []
            for d, s, e in sorted(regions):
                k = bisect.bisect(kept, (s, e))
                if (k == 0 or kept[k - 1][1] <= s) and (k == len(kept) or kept[k][0] >= e):
                    kept.insert(k, (s, e))
                    out.append((i, s, e, d))
        return out


def _matcher(shared):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            rows = [(d.as_py(), *x) for d, t in zip(b.column(0), b.column(1)) for x in index.search(t.as_py())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], pa.int64() if k < 4 else pa.int32()) for k in range(5)], ["doc_id", "rep", "start", "end", "distance"]
            )

    return match


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", q: int = Q, max_error: float = MAX_ERROR,
) -> DataFrame:
    """Regions of documents that hold a benchmark text within max_error of its length in edits:
    (doc_id, item_id, start, end, distance), for each document row and item all regions that do not overlap a nearer one,
    positions in code points.

    Both sides are compared as lower-case letters and digits with single blanks. An item of m characters with e edits shares
    m - q + 1 - q e q-grams with its match, all in a band of diagonals; bands with fewer are passed over and the others
    aligned. Items too short for that take shorter grams; those too short for any edit match as whole words. Equal items are
    searched for once. The benchmark is read in blocks of bounded size, each a pass over the documents.

    Null or empty texts hold nothing and are no benchmark, nor are texts without letter and digit; rows that repeat give
    their results again, on both sides; ids may be null; other columns are ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    named = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("t")).where("length(t) > 0")
    named = save(named.withColumn("rep", F.xxhash64("t")), "items")
    items = named.groupBy("rep").agg(F.first("t").alias("t"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    chars = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks, found = max(1, -(-chars // BLOCK_CHARS)), None
    for k in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod("rep", F.lit(blocks)) == k)
        index = spark.sparkContext.broadcast(Matcher(sorted(map(tuple, block.collect())), q, max_error))
        hits = rows.mapInArrow(_matcher(index), HITS)
        found = hits if found is None else found.unionByName(hits)
    return found.join(small(named.select("rep", "item_id")), "rep").select("doc_id", "item_id", "start", "end", "distance")


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, start, end, distance) for every document that holds a benchmark passage."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
