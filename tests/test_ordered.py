"""Running sums by ranges against plain ones, with a group that holds most rows, null groups and an empty table."""

import random

import pytest
from pyspark.sql import functions as F

from cartolode.operators.ordered import numbered, running


@pytest.mark.parametrize("by", [(), ("g",)])
def test_running_sums(spark, by):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a"] * 8 + ["b", "c", None]), k, rnd.randint(0, 9)) for k in rnd.sample(range(5000), 700)]
    df = spark.createDataFrame(rows, "g string, place int, size int").repartition(6)
    got = {r["place"]: (r["total"], r["g"]) for r in running(df, ["place"], F.col("size"), "total", by).collect()}
    seen, want = {}, {}
    for g, place, size in sorted(rows, key=lambda r: r[1]):
        key = g if by else 0
        seen[key] = seen.get(key, 0) + size
        want[place] = (seen[key], g)
    assert got == want
    down = [r["n"] for r in numbered(df, [F.desc("place")], "n").orderBy(F.desc("place")).collect()]
    assert down == list(range(1, 701))
    assert numbered(df.limit(0), ["place"], "n", by).count() == 0
