"""Differences of two snapshots, collisions of work streams, claims."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartolode.functions.scalar import ancestors
from cartolode.operators.ordered import numbered
from cartolode.operators.rules import health_score


def split(snap: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(snap.where(F.col("snapshot") == s).drop("snapshot") for s in ("base", "head"))


def diff_rows(base: DataFrame, head: DataFrame, keys: tuple, value: str) -> DataFrame:
    """Rows added, removed or modified between snapshots; a null value is a value like others."""
    sides = [side.select(*keys, F.col(value).alias(name), F.lit(True).alias(f"in_{name}")) for side, name in ((base, "old"), (head, "new"))]
    joined = sides[0].join(sides[1], list(keys), "full")
    status = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    return joined.withColumn("status", status).where("status is not null").drop("in_old", "in_new")


def came_and_went(base: DataFrame, head: DataFrame, keys: tuple) -> DataFrame:
    """(keys, added, removed) of the distinct rows of one snapshot that the other lacks, by one aggregation over both; a row with a
    null among its keys equals none."""
    sides = [d.select(*keys, F.lit(n).alias("sides")) for d, n in ((base, 1), (head, 2))]
    rows = sides[0].unionByName(sides[1]).groupBy(*keys).agg(F.bit_or("sides").alias("sides"))
    alone = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys]) | (F.col("sides") != 3)
    return rows.where(alone).select(*keys, (F.col("sides") >= 2).alias("added"), (F.col("sides") != 2).alias("removed"))


def diff_facts(base: DataFrame, head: DataFrame, key: str = "path", fact: str = "fact") -> DataFrame:
    """Per file how many facts came and went."""
    return came_and_went(base, head, (key, fact)).groupBy(key).agg(F.count_if("added").alias("added"), F.count_if("removed").alias("removed"))


def recurring(base: DataFrame, head: DataFrame, key: str, top: int = 5) -> DataFrame:
    counts = [d.groupBy(key).agg(F.count("*").alias(n)) for d, n in ((base, "before"), (head, "after"))]
    return counts[0].join(counts[1], key).orderBy(F.desc(F.col("before") + F.col("after")), key).limit(top)


def collisions_same(work: DataFrame) -> DataFrame:
    """Files that two streams change."""
    a, b = work.select("path", F.col("stream").alias("stream_a")), work.select("path", F.col("stream").alias("stream_b"))
    return a.join(b, "path").where("stream_a < stream_b")


def collisions_dep(work: DataFrame, edges: DataFrame) -> DataFrame:
    """A stream's file depends on a file that another stream changes; files that both change are left to collisions_same."""
    a = work.select(F.col("path").alias("src"), F.col("stream").alias("stream_a"))
    b = work.select(F.col("path").alias("dst"), F.col("stream").alias("stream_b"))
    pairs = edges.join(a, "src").join(b, "dst").where("stream_a <> stream_b")
    for side, stream in (("src", "stream_b"), ("dst", "stream_a")):
        pairs = pairs.join(work.select(F.col("path").alias(side), F.col("stream").alias(stream)), [side, stream], "left_anti")
    return pairs.select("stream_a", "stream_b", "src", "dst").distinct()


def merge_risk(work: DataFrame, same: DataFrame, dep: DataFrame) -> DataFrame:
    """Streams in the order to integrate them: least risk, fewest files, name. Shared files weigh 2, dependencies 1."""
    sides = [d.select(F.col(c).alias("stream"), F.lit(w).alias("w")) for d, w in ((same, 2), (dep, 1)) for c in ("stream_a", "stream_b")]
    hits = sides[0]
    for s in sides[1:]:
        hits = hits.unionByName(s)
    risk = hits.groupBy("stream").agg(F.count("*").alias("collisions"), F.sum("w").alias("risk"))
    files = work.groupBy("stream").agg(F.countDistinct("path").alias("files"))
    rows = files.join(risk, "stream", "left").fillna(0, ["collisions", "risk"])
    return numbered(rows, ["risk", "files", "stream"], "place")


def merge_hot_files(work: DataFrame) -> DataFrame:
    return work.groupBy("path").agg(F.countDistinct("stream").alias("streams")).where("streams >= 2")


def contended_claims(claims: DataFrame) -> DataFrame:
    """Claims(id, agent, target) that another agent contends by a claim on the same target, one above or one below.

    Each target and each folder knows only the smallest and largest agent that claims there, so that no pairs are formed.
    """
    span = lambda df: df.groupBy("place").agg(F.min("agent").alias("low"), F.max("agent").alias("high"))
    rows = claims.select("id", "agent", "target")
    at = span(rows.select(F.col("target").alias("place"), "agent"))
    within = span(rows.select(F.explode(ancestors(F.col("target"))).alias("place"), "agent"))
    above = rows.select("*", F.explode(ancestors(F.col("target"))).alias("place")).join(at, "place")
    below = rows.withColumn("place", F.col("target")).join(within, "place")
    return above.unionByName(below).where("low <> agent or high <> agent").select("id", "agent", "target").distinct()


def diff_issues(base: DataFrame, head: DataFrame, keys: tuple = ("rule_id", "path")) -> DataFrame:
    """Distinct issues that are new in head or resolved since base: (keys, status)."""
    sides = [a.select(*keys).distinct().join(b.select(*keys).distinct(), list(keys), "left_anti").withColumn("status", F.lit(n)) for a, b, n in ((head, base, "new"), (base, head, "resolved"))]
    return sides[0].unionByName(sides[1])


def score_delta(base: DataFrame, head: DataFrame, by: str = "source") -> DataFrame:
    """The health score of each group's issues before and after, and the difference; a group without issues has 100."""
    sides = [health_score(issues, (by,)).select(by, F.col("score").alias(name)) for issues, name in ((base, "before"), (head, "after"))]
    return sides[0].join(sides[1], by, "full").fillna(100, ["before", "after"]).withColumn("delta", F.col("after") - F.col("before"))
