"""Import-graph operators: degrees, bounded impact, cycles, reachability differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolode.functions.scalar import round_half_up
from cartolode.sources.tables import save


def coupling(edges: DataFrame) -> DataFrame:
    """Fan-in, fan-out and instability of every node of edges(src, dst)."""
    inward, outward = edges.groupBy(F.col("dst").alias("path")).agg(F.countDistinct("src").alias("fan_in")), edges.groupBy(F.col("src").alias("path")).agg(F.countDistinct("dst").alias("fan_out"))
    both = inward.join(outward, "path", "full").select("path", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("fan_in", "fan_out")])
    return both.withColumn("instability", round_half_up(F.col("fan_out") / (F.col("fan_in") + F.col("fan_out")), 2))


def impact(edges: DataFrame, seeds: DataFrame, max_distance: int = 10) -> DataFrame:
    """Everything that reaches seeds(path) along edges within so many hops: (path, distance). Each round is a written table of
    what it newly found."""
    back = save(edges.select(F.col("dst").alias("at"), F.col("src").alias("path")), "back")
    found = frontier = save(seeds.select("path", F.lit(0).alias("distance")).distinct(), "seeds")
    for hop in range(1, max_distance + 1):
        new = frontier.select(F.col("path").alias("at")).join(back, "at").select("path").distinct().join(found, "path", "left_anti")
        frontier = save(new.withColumn("distance", F.lit(hop)), "frontier")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def impact_report(edges: DataFrame, seeds: DataFrame, max_distance: int = 10) -> DataFrame:
    """impact, and whether anything lies one hop beyond: (path, distance, truncated)."""
    found = impact(edges, seeds, max_distance + 1)
    beyond = F.broadcast(found.agg(F.coalesce(F.max(F.col("distance") > max_distance), F.lit(False)).alias("truncated")))
    return found.where(F.col("distance") <= max_distance).crossJoin(beyond)


#: Steps of a spread that one job takes before its table is written and looked at.
HOPS = 3


def _trim(edges: DataFrame) -> DataFrame:
    """Edges left when nodes without predecessor or successor are taken away again and again. Sides of the rounds' joins are merged:
    broadcast, every one of them would go through the driver."""
    edges, n = save(edges.where("src <> dst").select("src", "dst").distinct(), "trimmed"), -1
    while n != (n := edges.count()):
        kept = edges.join(edges.select(F.col("dst").alias("src")).distinct().hint("merge"), "src", "left_semi")
        edges = save(kept.join(kept.select(F.col("src").alias("dst")).distinct().hint("merge"), "dst", "left_semi").select("src", "dst"), "trimmed")
    return edges


def _spread(edges: DataFrame, nodes: DataFrame, names: tuple[str, str]) -> DataFrame:
    """For every node the smallest node that reaches it along edges: (node, color). Each job takes HOPS steps; the nodes keep what
    they have by a step to themselves, so that a step is a join and an aggregation."""
    own = nodes.select("node", F.col("node").alias("to"))
    steps = save(edges.select(F.col(names[0]).alias("node"), F.col(names[1]).alias("to")).union(own).repartition("node"), "steps")
    color = save(nodes.select("node", F.col("node").alias("color")), "color")
    while True:
        new = color
        for _ in range(HOPS):
            new = steps.join(new.hint("merge"), "node").groupBy(F.col("to").alias("node")).agg(F.min("color").alias("color"))
        moved = new.join(color.withColumnRenamed("color", "before").hint("merge"), "node").select("node", "color", (F.col("color") < F.col("before")).alias("moved"))
        color = save(moved, "color")
        if color.where("moved").isEmpty():
            return color.drop("moved")
        color = color.drop("moved")


def cycles(edges: DataFrame) -> DataFrame:
    """Strongly connected components of two nodes or more: (node, component), named by their smallest node.

    Rounds of colouring: a node's colour is the smallest node that reaches it; within a colour, what reaches that node
    is its component. Components found are taken out and the rest is trimmed and coloured again. Nodes are numbers.
    """
    edges, parts = _trim(edges), []
    while not edges.isEmpty():
        nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
        color = _spread(edges, nodes, ("src", "dst"))
        inside = edges.join(color.select(F.col("node").alias("src"), F.col("color").alias("c")).hint("merge"), "src").join(color.select(F.col("node").alias("dst"), "color").hint("merge"), "dst")
        inside = save(inside.where("c = color").select("src", "dst"), "inside")
        back = _spread(inside, nodes, ("dst", "src"))
        whole = save(back.join(color.withColumnRenamed("color", "root").hint("merge"), "node").where("color = root").select("node", F.col("root").alias("component")), "components")
        parts.append(whole)
        gone = whole.select(F.col("node").alias("src")).hint("merge")
        edges = _trim(edges.join(gone, "src", "left_anti").join(gone.withColumnRenamed("src", "dst").hint("merge"), "dst", "left_anti"))
    spark: SparkSession = edges.sparkSession
    if not parts:
        return spark.createDataFrame([], "node long, component long")
    all_parts = parts[0]
    for p in parts[1:]:
        all_parts = all_parts.unionByName(p)
    sizes = all_parts.groupBy("component").count().where("count > 1").select("component")
    return all_parts.join(sizes.hint("merge"), "component", "left_semi").select("node", "component")
