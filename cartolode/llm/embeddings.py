"""Embedding near-duplicates: an exact metric range join over pivot cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, small, table
from .components import connected_components
from .simhash import _roots, _union

COSINE = 0.93
#: Different vectors that a cell is meant to hold, and that a tile of a larger cell holds from either side.
CELL, TILE = 1500, 2000
#: Pivots of one label, and of all together; they are broadcast.
LABEL_PIVOTS, PIVOTS = 64, 4096


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors as bytes of doubles; null for vectors that are null, empty, zero or hold null or non-finite parts."""
    for b in batches:
        out = []
        for x in b.column(2):
            v = None
            if x.is_valid and len(x.values) and not x.values.null_count:
                a = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                top = np.abs(a).max()
                if np.isfinite(a).all() and top > 0:
                    a = a / top
                    v = (a / np.sqrt(a @ a) + 0.0).tobytes()
            out.append(v)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["vec_id", "label", "v"])


def _matrix(v: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(v), np.float64).reshape(len(v), -1)


def _cells(pivots: dict, radius: float):
    """Deal vectors out: to the cell of the nearest pivot as its own, and to each cell within reach as a guest.

    If p is nearest to x and y lies within the radius of x, y's distances to q and p satisfy
    d(x,q)^2 - d(x,p)^2 <= 2 d(p,q) radius wherever q is nearest to y; other cells need not see x.
    """

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (label, dim), rows in b.groupby(["label", "dim"], sort=False):
                p = pivots.get((label, dim))
                if p is None:
                    yield rows.assign(cell=0, own=True)
                    continue
                square = np.maximum(2 - 2 * _matrix(rows["v"]) @ p.T, 0)
                home = square.argmin(1)
                apart = np.sqrt(np.maximum(2 - 2 * p @ p.T, 0))
                reach = square - square[np.arange(len(rows)), home][:, None] <= 2 * apart[home] * radius + 1e-9
                reach[np.arange(len(rows)), home] = True
                row, cell = np.nonzero(reach)
                yield rows.iloc[row].assign(cell=cell, own=cell == home[row])

    return deal


def _tile(cosine: float):
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        """Links of the tile's left rows, and a spanning forest of all links in the tile."""
        left, right = rows[rows["left"]], rows[~rows["left"]]
        if not len(left) or not len(right):
            return pd.DataFrame({"cid": [], "links": [], "root": []})
        a, b, n = _matrix(left["v"]), _matrix(right["v"]), right["n"].to_numpy()
        ids = np.concatenate([left["cid"], right["cid"]])
        nodes, node = np.unique(ids, return_inverse=True)
        parent, links = np.arange(len(nodes)), np.zeros(len(left), np.int64)
        for at in range(0, len(a), 256):
            near = a[at : at + 256] @ b.T >= cosine
            near &= ids[at : at + 256][: len(near), None] != ids[None, len(a) :]
            links[at : at + 256] = near @ n
            i, j = np.nonzero(near)
            _union(parent, node[at + i], node[len(a) + j])
        root = nodes[_roots(parent, np.arange(len(nodes)))]
        out = pd.DataFrame({"cid": left["cid"].to_numpy(), "links": links, "root": root[node[: len(a)]]})
        tied = nodes != root
        out = pd.concat([out[out["links"] > 0], pd.DataFrame({"cid": nodes[tied], "links": 0, "root": root[tied]})])
        return out.astype("int64")

    return compare


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row per vector: (vec_id, n_links, component_id, kept), linking vectors of equal label by cosine >= cosine.

    Equal vectors of a label are joined as one with a count, so that no group of copies is expanded. Labels with more
    different vectors than a cell should hold are cut by pivots, at most LABEL_PIVOTS each, drawn by hash; a vector
    goes to its own cell and, by the triangle inequality, to every other cell where a partner may be, and its links
    are counted in its own cell, which sees all of them. Cells too large for one task are compared in tiles.

    Vectors that are null, empty, zero or hold null or non-finite parts, and those with a null label, link with nothing;
    so do those of different length. Rows that repeat a vec_id count as different vectors. An empty table gives no rows.
    """
    spark, radius = vectors.sparkSession, float(np.sqrt(2 - 2 * cosine))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = save(rows.mapInArrow(_unit, "vec_id long, label string, v binary").withColumn("k", F.unhex(F.sha2("v", 256))), "vectors")
    valid = rows.where("label is not null and v is not null")
    classes = valid.groupBy("label", "k").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = save(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.octet_length("v")), "classes")
    large = classes.groupBy("label", "dim").count().where(F.col("count") > CELL).orderBy(F.desc("count"), "label", "dim").limit(PIVOTS).collect()
    wanted = {(r["label"], r["dim"]): min(LABEL_PIVOTS, -(-r["count"] // CELL)) for r in large}
    scale = min(1.0, PIVOTS / max(1, sum(wanted.values())))
    pivots: dict = {}
    if wanted:
        share = [(r["label"], r["dim"], 3.0 * wanted[r["label"], r["dim"]] * scale / r["count"]) for r in large]
        share = F.broadcast(spark.createDataFrame(share, "label string, dim int, share double"))
        place = F.pmod(F.xxhash64("k"), F.lit(1 << 40)) / F.lit(float(1 << 40))
        drawn = classes.join(share, ["label", "dim"]).where(place < F.col("share")).select("label", "dim", "v").orderBy("label", "v").limit(4 * PIVOTS)
        for key, found in drawn.toPandas().groupby(["label", "dim"]):
            if (n := int(wanted[key] * scale)) > 1:
                pivots[key] = _matrix(found["v"].head(n))
    dealt = classes.select("cid", "label", "dim", "v", "n").mapInPandas(_cells(pivots, radius), "cid long, label string, dim int, v binary, n long, cell long, own boolean")
    dealt = save(dealt, "cells")
    cell = ["label", "dim", "cell"]
    sizes = dealt.groupBy(cell).agg(F.count("*").alias("rows"), F.count_if("own").alias("owned")).where("owned > 0")
    sizes = small(save(sizes.select(*cell, F.ceil(F.col("owned") / TILE).alias("lefts"), F.ceil(F.col("rows") / TILE).alias("rights")), "sizes"))
    placed = dealt.join(sizes, cell)
    at = lambda n: F.pmod(F.xxhash64("cid"), F.col(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["cid", "v", "n", *cell]
    left = placed.where("own").select(*keys, F.lit(True).alias("left"), at("lefts").alias("i"), all_of("rights").alias("j"))
    right = placed.select(*keys, F.lit(False).alias("left"), all_of("lefts").alias("i"), at("rights").alias("j"))
    compared = save(left.unionByName(right).groupBy(*cell, "i", "j").applyInPandas(_tile(cosine), "cid long, links long, root long"), "tiles")
    roots = save(connected_components(compared.where("root <> cid").select(F.col("cid").alias("a"), F.col("root").alias("b"))), "roots")
    named = classes.select("cid", "label", "k", "n", "least").join(compared.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left")
    named = named.join(roots, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("component", "cid"))
    named = save(named.select("label", "k", "least", "root", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "named")
    least = save(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = save(named.join(least, "root").select("label", "k", "n_links", "component_id"), "classes")
    alone = rows.where("label is null or v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = valid.select("vec_id", "label", "k").join(named, ["label", "k"]).select("vec_id", "n_links", "component_id")
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op4_embedding_range_join(spark, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"))
