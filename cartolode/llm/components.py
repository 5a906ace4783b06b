"""Connected components by alternating star contraction, every round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def _mark(edges: DataFrame) -> tuple:
    """Count and an order-free checksum of the edge set."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(links: DataFrame) -> DataFrame:
    """Return (node, component) for every node that a link (a, b) names; component is the smallest node reachable.

    Links may repeat, point either way or be loops; null ends are ignored; no links give no rows. A node with very many
    links is never gathered in one task: minima are pre-aggregated, and they are written before they are joined, so
    that both join sides are plain exchanges whose hot partitions Spark splits.
    """
    edges = save(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = save(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = save(
            both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large"
        )
        low = save(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        edges = save(
            large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low).distinct(),
            "edges",
        )
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
