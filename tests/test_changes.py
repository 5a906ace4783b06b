"""Differences of snapshots on small rows."""

from cartolode.operators import changes


def test_facts_that_came_and_went_take_one_aggregation_and_no_join(spark):
    side = lambda rows: spark.createDataFrame(rows, "path long, fact string")
    base = side([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (3, None), (None, "x")])
    head = side([(1, "a"), (1, "c"), (1, "c"), (2, "a"), (3, None), (4, "d")])
    df = changes.diff_facts(base, head)
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert {r["path"]: (r["added"], r["removed"]) for r in df.collect()} == {1: (1, 1), 3: (1, 1), 4: (1, 0), None: (0, 1)}
