"""Hard-negative mining: cover trees over norm-augmented candidates, searched best first within score windows.

A candidate gets one more component, so that all have the same norm; an inner product then follows from the angle to the
anchor, and the radius that covers all below a node bounds it. Candidates are dealt to the cells of pivots, which are the
first level below the root, and each cell's rows to trees that fit in a task.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save, small, table

POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Rows that pivots are chosen from, pivots of all lengths of vectors together, lengths that get pivots, rows of a cell aimed at.
SAMPLE, PIVOTS, LENGTHS, CELL = 20_000, 1024, 16, 32_768
#: Rows of a tree, rows of a leaf, anchors that meet a tree in one task, cells that an anchor visits before it has thresholds.
TREE, LEAF, BLOCK, FIRST = 16_384, 256, 512, 2
EXACT, TOP = 2.0**53, (1 << 63) - 1
QUERY = "rid long, label long, dim int, v binary, windows array<struct<w:int,base:long,least:long>>"


def _whole_numbers(scale: float):
    """(vec_id, label, dim, v): v the floors of scale times the components, in 2 or 8 bytes each; rows that take no part go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, dims, out = [], [], []
            for k, x in enumerate(b.column(2)):
                if not x.is_valid or x.values.null_count:
                    continue
                with np.errstate(all="ignore"):
                    a = np.floor(scale * x.values.to_numpy(zero_copy_only=False).astype(np.float64))
                top = np.abs(a).max(initial=0)
                if top < 2.0**63:  # false for what is not finite too
                    keep.append(k), dims.append(len(a)), out.append(a.astype(np.int16 if top < 2**15 else np.int64).tobytes())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["vec_id", "label", "dim", "v"])

    return run


def _matrix(v, dim: int) -> np.ndarray:
    if not dim:
        return np.zeros((len(v), 0))
    if all(len(x) == 2 * dim for x in v):
        return np.frombuffer(b"".join(v), np.int16).reshape(len(v), dim).astype(np.float64)
    return np.stack([np.frombuffer(x, np.int16 if len(x) == 2 * dim else np.int64) for x in v]).astype(np.float64)


def _norm(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(-1))


def farthest_first(y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres, each the row farthest from those before; their distances to those before; each row's nearest centre."""
    centres, gaps, near, apart = [0], [np.inf], np.zeros(len(y), np.int64), _norm(y - y[0])
    while len(centres) < most and apart.max() > 0:
        centres.append(int(apart.argmax()))
        gaps.append(apart[centres[-1]])
        d = _norm(y - y[centres[-1]])
        near[d < apart] = len(centres) - 1
        apart = np.minimum(apart, d)
    return np.array(centres), np.array(gaps), near


def cover_tree(x: np.ndarray, key: np.ndarray) -> dict[str, np.ndarray]:
    """Nodes level by level: center row, parent, the covering radius in x (plain) and with the added component (wide), the
    least key below, and the rows of leaves as first and one past the last in order. A level's centres are those that are
    farther apart than its scale, which halves from level to level; the last level's nodes are leaves."""
    square = (x * x).sum(1)
    y = np.column_stack([x, np.sqrt(np.maximum(square.max() - square, 0))])
    centres, gaps, near = farthest_first(y, -(-len(x) // LEAF))
    levels, scale = [1], gaps[1] if len(gaps) > 1 else 0
    while levels[-1] < len(centres):
        scale /= 2
        n = int((gaps > scale).sum())
        if n > levels[-1]:
            levels.append(n)
    ups = []  # of each level below the root, its centres' centres in the level above: the same or the nearest
    for above, n in zip(levels, levels[1:]):
        ups.append(np.arange(n))
        for c in range(above, n):
            ups[-1][c] = _norm(y[centres[:above]] - y[centres[c]]).argmin()
    first = np.cumsum([0] + levels)
    center = np.concatenate([centres[:n] for n in levels])
    parent, begin, end = (np.full(first[-1], -1) for _ in range(3))
    plain, wide, low = np.zeros(first[-1]), np.zeros(first[-1]), np.zeros(first[-1], np.int64)
    at = near
    for level in range(len(levels) - 1, -1, -1):
        if level < len(levels) - 1:
            parent[first[level + 1] : first[level + 2]] = first[level] + ups[level]
            at = ups[level][at]
        node, c = first[level] + at, center[first[level] + at]
        np.maximum.at(plain, node, _norm(x - x[c]))
        np.maximum.at(wide, node, _norm(y - y[c]))
        low[first[level] : first[level + 1]] = TOP
        np.minimum.at(low, node, key)
    order = np.argsort(near, kind="stable")
    edge = np.searchsorted(near[order], np.arange(len(centres) + 1))
    begin[first[-2] :], end[first[-2] :] = edge[:-1], edge[1:]
    return {"center": center, "parent": parent, "plain": plain, "wide": wide, "low": low, "order": order, "begin": begin, "end": end, "norm": np.sqrt(square.max(keepdims=True))}


def _built(rows: pd.DataFrame) -> pd.DataFrame:
    dim = int(rows["dim"].iloc[0])
    x = _matrix(rows["v"], dim)
    key = rows["key"].to_numpy(np.int64)
    tree, out = cover_tree(x, key), io.BytesIO()
    order = tree.pop("order")
    center = np.argsort(order)[tree.pop("center")]
    x, label, rid = x[order], rows["label"].to_numpy(np.int64)[order], rows["rid"].to_numpy(np.int64)[order]
    x = x.astype(np.int16) if np.abs(x).max(initial=0) < 2**15 else np.stack([np.frombuffer(v, np.int16 if len(v) == 2 * dim else np.int64) for v in rows["v"]])[order]
    np.savez(out, x=x, key=key[order], label=label, rid=rid, center=center, **tree)
    return pd.DataFrame({"dim": [dim], "cell": rows["cell"].iloc[:1].astype("int32"), "part": rows["part"].iloc[:1].astype("int32"), "tree": [out.getvalue()]})


def inner(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products; beyond a double's whole numbers in Python's integers, at most a long's limits."""
    if exact:
        return (x @ q.astype(np.float64)).astype(np.int64)
    q = [int(a) for a in q]
    return np.array([max(-TOP - 1, min(TOP, sum(a * int(b) for a, b in zip(q, row)))) for row in x], np.int64)


def bounds(score: np.ndarray, q: float, norm: float, plain: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of an anchor of norm q with what is below nodes, from the centres' scores."""
    size = q * norm
    slack = size * 1e-9
    reach = q * plain * (1 + 1e-9) + (slack if size >= EXACT else 0)
    if not size:
        return score - reach, score + reach
    angle = np.arccos(np.clip(score / size, -1, 1))
    turn = 2 * np.arcsin(np.clip(wide / (2 * norm), 0, 1)) + 1e-7
    return np.maximum(score - reach, size * np.cos(np.minimum(angle + turn, np.pi)) - slack), np.minimum(score + reach, size * np.cos(np.maximum(angle - turn, 0)) + slack)


def window(base: int | None, least: int | None, shares: tuple[int, int]) -> tuple[int, int]:
    """Least and largest score of a window: all, or the shares of the base score in hundredths; not below least."""
    low, high = (-TOP - 1, TOP) if base is None else (-(-shares[0] * base // 100), shares[1] * base // 100)
    return low if least is None else max(low, least), high


def descend(tree, children: list, label: int, rid: int, same: bool, k: int, windows: list, low: np.ndarray, high: np.ndarray, q: np.ndarray, x: np.ndarray, exact: bool) -> list:
    """The first k of each window among the tree's rows, as (w, -score, key, rid), nodes in order of their upper bound."""
    best: list[list] = [[] for _ in windows]

    def wanted(node: int) -> bool:
        for (_, a, b), found in zip(windows, best):
            if high[node] >= a and low[node] <= b and (len(found) < k or (-high[node], tree["low"][node]) < found[-1][:2]):
                return True
        return False

    heap = [(-high[0], 0)]
    while heap:
        node = heapq.heappop(heap)[1]
        if not wanted(node):
            continue
        if tree["begin"][node] < 0:
            for c in children[node]:
                if wanted(c):
                    heapq.heappush(heap, (-high[c], c))
            continue
        rows = slice(tree["begin"][node], tree["end"][node])
        score, key = inner(q, x[rows], exact), tree["key"][rows]
        fits = ((tree["label"][rows] == label) == same) & (tree["rid"][rows] != rid)
        for i, (_, a, b) in enumerate(windows):
            at = np.flatnonzero(fits & (score >= a) & (score <= b))
            if len(at):
                at = at[np.lexsort((key[at], -score[at].astype(np.float64) if exact else -(score[at] // 2)))][: k if exact else None]
                best[i] = sorted([*best[i], *((-int(score[j]), int(key[j]), int(tree["rid"][rows.start + j])) for j in at)])[:k]
    return [(w, *row) for (w, *_), found in zip(windows, best) for row in found]


def _searched(same: bool, k: int, shares: tuple[int, int]):
    def run(anchors: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        out = []
        for packed in trees["tree"]:
            tree = dict(np.load(io.BytesIO(packed)))
            x = tree["x"]
            exact = x.dtype == np.int16
            wide = x.astype(np.float64)
            children: list[list[int]] = [[] for _ in tree["parent"]]
            for node, up in enumerate(tree["parent"].tolist()):
                if up >= 0:
                    children[up].append(node)
            norm = float(tree["norm"][0])
            centres = wide[tree["center"]]
            for a in anchors.itertuples(index=False):
                q = np.frombuffer(a.v, np.int16 if len(a.v) == 2 * a.dim else np.int64) if a.dim else np.zeros(0, np.int16)
                size = float(_norm(q.astype(np.float64)))
                fine = size * norm < EXACT and (exact or float(np.abs(wide).max(initial=0)) < EXACT)
                low, high = bounds(centres @ q.astype(np.float64), size, norm, tree["plain"], tree["wide"])
                windows = [(w["w"], *window(w["base"], w["least"], shares)) for w in a.windows]
                for w, minus, key, rid in descend(tree, children, a.label, a.rid, same, k, windows, low, high, q, wide if fine else x, fine):
                    out.append((a.rid, w, rid, None if key == TOP else key, -minus))
        found = pd.DataFrame(out, columns=["rid", "w", "other", "vec_id", "score"])
        return found.astype({"rid": "int64", "w": "int32", "other": "int64", "vec_id": "Int64", "score": "int64"})

    return run


def _visits(cells: dict, first: bool, shares: tuple[int, int]):
    """Copies of the anchors for the cells that they visit first, or for all others that their windows reach."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            row, cell = [], []
            for i, a in enumerate(b.itertuples(index=False)):
                if a.dim not in cells:
                    row += [i] * first
                    cell += [0] * first
                    continue
                number, centre, radius, norm = cells[a.dim]
                q = _matrix([a.v], a.dim)[0]
                score = centre @ q
                low, high = bounds(score, float(_norm(q)), norm, radius, np.full(len(radius), 2 * norm))
                reach, own = np.zeros(len(number), bool), np.zeros(len(number), bool)
                for w in a.windows:
                    least, most = window(w["base"], None, shares)
                    own |= (high >= least) & (low <= most)
                    least, most = window(w["base"], w["least"], shares)
                    reach |= (high >= least) & (low <= most)
                aim = max(window(w["base"], None, shares)[1] for w in a.windows)
                near = np.lexsort((np.abs(score - float(aim)) if aim < TOP else -score, ~own))[:FIRST]
                near = near[own[near]]
                if first:
                    reach[:] = False
                    reach[near] = True
                else:
                    reach[near] = False
                at = np.flatnonzero(reach)
                row += [i] * len(at)
                cell += number[at].tolist()
            yield b.iloc[row].assign(cell=np.array(cell, np.int32))

    return run


class Index:
    """All rows that take part, dealt to the cells of pivots and into cover trees, as written tables."""

    def __init__(self, rows: DataFrame):
        self.rows, spark = rows, rows.sparkSession
        counts = rows.groupBy("dim").count().where("dim > 0").orderBy(F.desc("count"), "dim").limit(LENGTHS).collect()
        total = max(1, sum(r["count"] for r in counts))
        place = F.pmod(F.xxhash64("rid", "v"), F.lit(1 << 40)) / F.lit(float(1 << 40))
        drawn = rows.where(F.col("dim").isin([r["dim"] for r in counts]) & (place < SAMPLE / total)).select("dim", "v").limit(2 * SAMPLE).toPandas()
        pivots = {}
        for dim, found in drawn.groupby("dim"):
            n = next(r["count"] for r in counts if r["dim"] == dim)
            x = np.unique(_matrix(found["v"], dim), axis=0)
            pivots[dim] = x[farthest_first(x, max(1, min(PIVOTS * n // total, -(-n // CELL))))[0]]

        def cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for dim, part in b.groupby("dim", sort=False):
                    x = _matrix(part["v"], dim)
                    p = pivots.get(dim, np.zeros((1, dim)))
                    near = ((p * p).sum(1) - 2 * x @ p.T).argmin(1)
                    yield part.assign(cell=near.astype(np.int32), apart=_norm(x - p[near]), norm=_norm(x))

        keyed = rows.select("rid", F.coalesce("vec_id", F.lit(TOP)).alias("key"), "label", "dim", "v")  # in pandas, nulls would make them doubles
        dealt = save(keyed.mapInPandas(cell, "rid long, key long, label long, dim int, v binary, cell int, apart double, norm double"), "cells")
        sizes = save(dealt.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("apart").alias("radius"), F.max("norm").alias("norm")), "sizes")
        self.sizes = sizes.select("dim", "cell", F.ceil(F.col("n") / TREE).cast("int").alias("parts"))
        self.cells = {}
        for dim, found in sizes.where(F.col("dim").isin(list(pivots))).toPandas().groupby("dim"):
            number = found["cell"].to_numpy()
            self.cells[dim] = (number, pivots[dim][number], found["radius"].to_numpy(), float(found["norm"].max()))
        parted = dealt.join(small(self.sizes), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"))
        grown = parted.select("rid", "key", "label", "dim", "v", "cell", "part").groupBy("dim", "cell", "part").applyInPandas(_built, "dim int, cell int, part int, tree binary")
        self.trees = save(grown, "trees")

    def _round(self, queries: DataFrame, first: bool, same: bool, k: int, shares: tuple[int, int]) -> DataFrame:
        dealt = save(queries.mapInPandas(_visits(self.cells, first, shares), QUERY + ", cell int"), "visits")
        blocks = save(dealt.groupBy("dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).join(self.sizes, ["dim", "cell"]), "blocks")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        keys = ["dim", "cell", "part", "block"]
        placed = dealt.join(small(blocks), ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")).withColumn("part", each("parts")).drop("blocks", "parts")
        trees = self.trees.join(small(blocks.drop("parts")), ["dim", "cell"]).withColumn("block", each("blocks")).drop("blocks")
        met = placed.groupBy(keys).cogroup(trees.groupBy(keys)).applyInPandas(_searched(same, k, shares), "rid long, w int, other long, vec_id long, score long")
        return save(met, "met")

    def search(self, queries: DataFrame, same: bool, k: int, shares: tuple[int, int] = (0, 0)) -> DataFrame:
        """The first k rows of the anchors' label, or of other labels, in each window: (rid, w, rank, other, vec_id, score)."""
        rank = F.row_number().over(Window.partitionBy("rid", "w").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "other"))
        met = self._round(queries, True, same, k, shares)
        least = met.withColumn("rank", rank).where(F.col("rank") == k).select("rid", "w", F.col("score").alias("found"))
        flat = queries.select("rid", F.explode("windows").alias("x")).select("rid", "x.w", "x.base").join(least, ["rid", "w"], "left")
        raised = flat.groupBy("rid").agg(F.collect_list(F.struct("w", "base", F.col("found").alias("least"))).alias("windows"))
        rest = self._round(queries.drop("windows").join(raised, "rid").select("rid", "label", "dim", "v", "windows"), False, same, k, shares)
        return save(met.unionByName(rest).withColumn("rank", rank).where(F.col("rank") <= k), "ranked")


def mine_negatives(
    vectors: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: float = 256.0,
    positives: int = POSITIVES, negatives: int = NEGATIVES, shares: tuple[int, int] = (LOW, HIGH),
) -> DataFrame:
    """For each row that anchor (a condition on id_col) names and each of its first positives of the same label: the first rows
    of other labels whose score lies between the shares, in hundredths, of the positive's score. Returns (anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score); scores are inner products of floor(scale * component).

    Rows take no part if their label or vector is null, if a component is null or not finite, or if its floor does not fit
    in a long. Vectors of different length never meet; those of no components score 0. Higher scores come first, ties go to
    smaller ids, null ids last. Rows that repeat an id, or are equal, each count. Scores beyond a long are cut to its limits.
    An anchor without positives and a window without rows give nothing, as does an empty table. Other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where("label is not null and v is not null").mapInArrow(_whole_numbers(scale), "vec_id long, label long, dim int, v binary")
    rows = save(rows.withColumn("rid", F.monotonically_increasing_id()).select("rid", "vec_id", "label", "dim", "v"), "rows")
    index = Index(rows)
    anchors = rows.withColumnRenamed("vec_id", id_col).where(anchor).withColumnRenamed(id_col, "anchor_id")
    no = F.lit(None).cast("long")
    every = F.array(F.struct(F.lit(0).alias("w"), no.alias("base"), no.alias("least")))
    found = index.search(anchors.select("rid", "label", "dim", "v", every.alias("windows")), True, positives)
    found = found.select("rid", F.col("rank").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    windows = found.groupBy("rid").agg(F.collect_list(F.struct("w", F.col("positive_score").alias("base"), no.alias("least"))).alias("windows"))
    mined = index.search(anchors.join(windows, "rid").select("rid", "label", "dim", "v", "windows"), False, negatives, shares)
    mined = mined.select("rid", "w", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = mined.join(found, ["rid", "w"]).join(anchors.select("rid", "anchor_id"), "rid")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT p.*, other AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
    AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
