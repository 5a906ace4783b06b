"""Running sums and numbers over long orders, without a window that gathers all rows or a whole group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolode.sources.tables import save

#: Offsets are broadcast up to so many rows, one for each range of rows and group in it.
OFFSETS = 200_000


def running(df: DataFrame, order: list, size: Column, name: str, by: tuple = ()) -> DataFrame:
    """df with the running sum of size in the given order, of each group by itself; the order should leave no ties.

    Rows are dealt into ranges of group and order, written once; each range adds up its own rows, and what the ranges before
    hold of the same group comes from their totals, a row for each range and group.
    """
    ranged = save(df.withColumn("_size", size).repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("_range", *by).agg(F.sum("_size").alias("_total"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = save(totals.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0))), "offsets")
    sides = offsets.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], "_before")
    sides = F.broadcast(sides) if sides.limit(OFFSETS + 1).count() <= OFFSETS else sides
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(by)], F.col("_range") == F.col("_r"))
    own = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = ranged.withColumn("_own", F.sum("_size").over(own)).join(sides, same)
    return rows.select(*df.columns, (F.col("_own") + F.col("_before")).alias(name))


def numbered(df: DataFrame, order: list, name: str, by: tuple = ()) -> DataFrame:
    """df with the place of each row in the order, of each group by itself, from 1."""
    return running(df, order, F.lit(1).cast("long"), name, by)
