"""Shuffles as wide as the tables ask for, and tasks as many as there are files."""

import pytest

from cartolode.operators import facts, history, review
from cartolode.plans import registry
from cartolode.sources import tables

SF = "/root/testdata/sf0.001"
WIDTH = "spark.sql.shuffle.partitions"


def widths(spark, monkeypatch, name, rows=100):
    """How wide shuffles are at each table that a query writes, where a task is dealt so many rows."""
    seen, write = [], tables.save

    def save(df, label):
        seen.append(int(spark.conf.get(WIDTH)))
        return write(df, label)

    monkeypatch.setattr(tables, "TASK_ROWS", rows, raising=False)
    for module in (tables, history):
        monkeypatch.setattr(module, "save", save)
    before = spark.conf.get(WIDTH)
    registry.QUERIES[name](spark, SF)
    assert spark.conf.get(WIDTH) == before
    return seen


def asked(spark, rows=100):
    return -(-tables.table(spark, SF, "lineitem").count() // rows)


def test_contracts_that_came_and_went_take_one_aggregation(spark):  # F11
    side = lambda rows: spark.createDataFrame(rows, "path long, name string")
    base, head = side([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (3, None)]), side([(1, "a"), (1, "c"), (1, "c"), (2, "z"), (3, None)])
    df = review.diff_contracts(base, head, spark.createDataFrame([(1,), (3,), (3,)], "path long"))
    assert "LeftAnti" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, df.collect()), key=repr) == [(1, "b", "removed"), (1, "c", "added"), (3, None, "added"), (3, None, "removed")]


@pytest.mark.parametrize("name", ["diff_contracts", "collisions_transitive", "diff_cycles", "diff_cycles_scoped", "author_shares", "bus_factor", "read_targets", "hotspots"])  # F11 F12 F14 F15 F20 F21 F24 F25
def test_shuffles_are_as_wide_as_the_rows_ask_for(spark, monkeypatch, name):
    seen = widths(spark, monkeypatch, name)
    assert seen and set(seen) == {asked(spark)}


def test_few_rows_leave_shuffles_as_they_are(spark, monkeypatch):
    assert set(widths(spark, monkeypatch, "author_shares", 10**9)) == {int(spark.conf.get(WIDTH))}


def test_files_of_one_partition_are_read_by_many_tasks(spark):  # F13
    files = spark.createDataFrame([(f"m{k}.go", "package p\n") for k in range(100)], "path string, content string").coalesce(1)
    df = facts.extract_facts(files)
    assert df.rdd.getNumPartitions() >= int(spark.conf.get(WIDTH))
    assert df.where("kind = 'file'").count() == 100


def test_small_partitions_are_put_together_up_to_little(spark):  # F21
    """A few MB of packed rows are some hundred MB in a task: the bound is reached by small tables already, and large ones stay at it."""
    with tables.wide(spark, 1):
        assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "4m"
