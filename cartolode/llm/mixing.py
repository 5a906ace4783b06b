"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, save, small, table

#: Bits of the hash that each histogram level looks at; three levels tell 2^30 places apart.
LEVEL_BITS, LEVELS = 10, 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(source, source_size, target) for each source of sizes(source, size).

    Sources in code-point order, null last, weigh as weights repeat. All sizes together are shared by weight; what a
    source would get above cap times its size is shared again among the others, which ends at one water level: with
    sources in order of cap times size over weight, the capped ones are a prefix. One row per source enters the window.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("rank", F.row_number().over(order)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    )
    ranked = ranked.withColumn("most", F.lit(cap) * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    rising, everything = Window.orderBy("ratio", "rank"), Window.partitionBy()
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    level = ranked.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    ).withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    return level.select(
        "source", "source_size", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target")
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (1, 2, 3),
    cap: float = 3.0,
) -> DataFrame:
    """Decide how often each document enters the mix: (doc_id, source, size, source_size, target, copies, taken).

    A source whose target is f times its size takes every document floor(f) times and, for the rest, the documents
    whose hash lies below a threshold. Words are summed by source and hash bucket; the bucket where the budget ends is
    the only one refined, level by level, and no rows are sorted. The last bucket is taken if that comes nearer.

    Null or empty texts have size 0 and are taken with 0 words; a null source is a source of its own; rows that repeat
    hash alike and are taken or left together; ids may be null; extra columns are ignored; an empty table gives no rows.
    """
    sized = save(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(F.col(text_col)).alias("size"),
            F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col)).alias("h"),
        ),
        "sizes",
    )
    targets = save(
        source_targets(sized, weights, cap)
        .withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0))
        .withColumn("budget", F.greatest(F.lit(0.0), F.col("target") - F.col("full") * F.col("source_size"))),
        "targets",
    )
    # Where each source's budget ends: all hashes whose leading bits lie under `edge` are in.
    edges = targets.select("source", F.lit(0).cast("long").alias("edge"), F.col("budget").alias("left"))
    for level in range(1, LEVELS + 1):
        shift = 64 - LEVEL_BITS * level
        lead = F.shiftrightunsigned("h", shift)
        inside = sized.where("size > 0").withColumn("lead", lead)
        e = small(edges.withColumnRenamed("source", "s"))
        if level > 1:
            inside = inside.withColumn("up", F.shiftrightunsigned("h", shift + LEVEL_BITS))
            inside = inside.join(e, F.col("source").eqNullSafe(F.col("s")) & (F.col("up") == F.col("edge"))).drop("s", "edge", "left", "up")
        hist = inside.groupBy("source", "lead").agg(F.sum("size").alias("words"))
        run = Window.partitionBy("source").orderBy("lead")
        ends = (
            hist.withColumn("upto", F.sum("words").over(run))
            .join(e, F.col("source").eqNullSafe(F.col("s")))
            .where(F.col("upto") > F.col("left"))
            .groupBy("source")
            .agg(F.min(F.struct("lead", "upto", "words", "left")).alias("x"))
        )
        edges = save(
            ends.select(
                "source",
                (F.col("x.lead") + F.when((F.lit(level) == LEVELS) & (2 * (F.col("x.left") - F.col("x.upto") + F.col("x.words")) > F.col("x.words")), 1).otherwise(0)).alias("edge"),
                (F.col("x.left") - F.col("x.upto") + F.col("x.words")).alias("left"),
            ),
            "edges",
        )
    final = targets.join(edges.select(F.col("source").alias("s"), "edge"), F.col("source").eqNullSafe(F.col("s")), "left")
    final = save(final.select(F.col("source").alias("s"), "source_size", "target", "full", "edge"), "thresholds")
    lead = F.shiftrightunsigned("h", 64 - LEVEL_BITS * LEVELS)
    copies = (F.col("full") + F.when(F.col("edge").isNotNull() & (lead < F.col("edge")), 1).otherwise(0)).cast("long")
    return (
        sized.join(small(final), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("copies", copies)
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), "h")
    )


def op10_mix_hash_threshold(spark, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
