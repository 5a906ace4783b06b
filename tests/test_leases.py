"""Leases: the sweep against a plain replay, and the stream against the sweep."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cartolode.streaming import leases

EVENTS = "repo string, id string, at timestamp, action string, agent string, target string, expires_at timestamp"


def at(k):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k)


def overlap(a, b):
    return a == b or b.startswith(a + "/") or a.startswith(b + "/")


def plain(events):
    out, held = [], {}
    for repo, i, t, action, agent, target, expires in sorted(events, key=lambda e: (e[2], e[3], e[1] or "")):
        active = {k: v for k, v in held.items() if k[0] == repo and (v[3] is None or v[3] > t)}
        if action == "claim":
            out.append((repo, i, t, "claimed", agent, target, sum(v[1] != agent and overlap(v[2], target) for v in active.values())))
            held[repo, i] = (i, agent, target, expires)
        else:
            for k, v in active.items():
                if v[0] == i if i else (target in (None, v[2]) and agent in (None, v[1]) and (target, agent) != (None, None)):
                    out.append((repo, v[0], t, "released", v[1], v[2], 0))
                    del held[k]
    last = max(e[2] for e in events)
    return sorted(out + [(k[0], v[0], v[3], "expired", v[1], v[2], 0) for k, v in held.items() if v[3] is not None and v[3] <= last], key=str)


def some(seed, n):
    rnd = random.Random(seed)
    events = []
    for k in range(n):
        t, repo = rnd.randrange(n // 2), rnd.choice("rs")
        target = "/".join(rnd.choice("ab") for _ in range(rnd.randint(1, 4)))
        if rnd.random() < 0.7:
            events.append((repo, f"c{k}", at(t), "claim", rnd.choice("xyz"), target, rnd.choice([None, at(t + rnd.randint(1, n)), at(t)])))
        else:
            way = rnd.randrange(4)
            events.append((repo, f"c{rnd.randrange(n)}" if way == 0 else None, at(t), "release", rnd.choice("xyz") if way in (1, 3) else None, target if way in (1, 2) else None, None))
    return events


@pytest.mark.parametrize("seed", [1, 2])
def test_sweep_equals_replay(spark, seed):
    events = some(seed, 120)
    got = leases.lease_log(spark.createDataFrame(events, EVENTS)).collect()
    assert sorted(map(tuple, got), key=str) == plain(events)


def test_stream_equals_sweep(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = some(3, 60)
    far = at(10_000)
    batches = [[e for e in events if e[2] < at(15)], [e for e in events if e[2] >= at(15)], [("q", "z", far, "claim", "x", "a", None)], [("q", "zz", far, "claim", "x", "b", None)]]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(source)
        feed = spark.readStream.schema(EVENTS).parquet(source)
        query = leases.watch_leases(feed).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = spark.read.schema(leases.LEASES).parquet(out).where("repo <> 'q'").collect()
    want = leases.lease_log(spark.createDataFrame(events, EVENTS), until=str(far)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str) and any(r["event"] == "expired" for r in got)


def test_claims_of_the_reports(spark):
    rows = [("r", "1", at(0), "claim", "a", "src", None), ("r", "2", at(1), "claim", "b", "src/x.ts", at(3)), ("r", "3", at(2), "claim", "b", "docs", None), ("r", "4", at(2), "claim", "a", "src", None), ("r", "5", at(3), "claim", "a", "src/x.ts", None)]
    got = {r["id"]: r["contenders"] for r in leases.lease_log(spark.createDataFrame(rows, EVENTS)).where("event = 'claimed'").collect()}
    assert got == {"1": 0, "2": 1, "3": 0, "4": 1, "5": 0}
    assert leases.lease_log(spark.createDataFrame(rows[:0], EVENTS)).count() == 0


def test_claims_are_told_once(spark, monkeypatch):  # F16
    told = spark.sparkContext.accumulator(0)

    def seen(i):
        told.add(1)
        return i

    counted = F.udf(seen, "string").asNondeterministic()
    events = spark.createDataFrame([("r", str(k), at(k), "claim", "ab"[k % 2], "x", None) for k in range(20)], EVENTS)
    rows = leases.contention(leases.ended(events).withColumn("id", counted("id"))).collect()
    assert len(rows) == 20 and told.value == 20
