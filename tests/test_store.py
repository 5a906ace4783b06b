"""The store of facts and edges against a replay of all changes, and its reruns and files."""

import datetime as dt
import random
import uuid

from pyspark.sql import functions as F

from cartolode.streaming.store import FactStore, refresh_stream

CHANGES = "path string, content string, at timestamp"
FACTS = "path string, word string"


def extract(files):
    """A row for the file and one for each of its words."""
    return files.select("path", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.filter(F.split("content", " "), lambda w: w != ""))).alias("word"))


def targets(facts):
    return facts.where("word is not null").select("path", F.col("word").alias("target"))


def at(k):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=k)


def some(seed, batches):
    rnd = random.Random(seed)
    names = [f"f{k}" for k in range(25)]
    text = lambda: None if rnd.random() < 0.25 else " ".join(rnd.choice(names) for _ in range(rnd.randint(0, 4)))
    return [[(rnd.choice(names), text(), at(10 * b + rnd.randrange(5))) for _ in range(rnd.randint(0, 8))] for b in range(batches)] + [[(None, "f1", at(0))]]


def replay(batches):
    files = {}
    for rows in batches:
        latest = {}
        for path, content, t in rows:
            if path is not None:
                latest[path] = max(latest.get(path, (t, content is not None, content or "")), (t, content is not None, content or ""))
        for path, (_, there, content) in latest.items():
            files.pop(path, None)
            if there:
                files[path] = content
    facts = {(p, w) for p, c in files.items() for w in [None, *filter(None, c.split(" "))]}
    return facts, {(p, w) for p, w in facts if w in files}


def held(store):
    return {tuple(r) for r in store.read().collect()}, {tuple(r) for r in store.edges().collect()}


def test_batches_equal_a_replay_and_reruns_change_nothing(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "store"), FACTS, extract, targets, buckets=8)
    batches = some(1, 6)
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, CHANGES)
        store.apply(df, n)
        assert held(store) == replay(batches[: n + 1])
        if n % 2:
            before = store.manifest()
            store.apply(df, n)
            assert held(store) == replay(batches[: n + 1]) and store.manifest() == before


def test_a_batch_writes_the_buckets_it_touches(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "store"), FACTS, extract, targets, buckets=32)
    store.apply(spark.createDataFrame([(f"f{k}", f"f{(k + 1) % 200}", at(0)) for k in range(200)], CHANGES), 0)
    store.apply(spark.createDataFrame([("f7", "f9", at(1))], CHANGES), 1)
    written = lambda kind, n: len(list((tmp_path / "store" / kind / f"version={n}").glob("bucket=*")))
    assert written("facts", 0) == 32 and written("facts", 1) == 1 and written("edges", 1) <= 3
    assert ("f7", "f9") in held(store)[1] and ("f7", "f8") not in held(store)[1] and len(held(store)[1]) == 200
    # A batch that dies before its manifest is in place is not seen.
    store._commit = lambda *_: (_ for _ in ()).throw(RuntimeError)
    try:
        store.apply(spark.createDataFrame([("f1", None, at(2))], CHANGES), 2)
    except RuntimeError:
        pass
    del store._commit
    assert len(held(store)[1]) == 200
    store.apply(spark.createDataFrame([("f1", None, at(2))], CHANGES), 2)
    assert len(held(store)[1]) == 198


def test_stream(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "store"), FACTS, extract, buckets=4)
    source, batches = str(tmp_path / "in"), [[("a", "x y", at(1)), ("a", "z", at(2)), ("b", "y", at(1))], [("b", None, at(3)), ("c", "z", at(3))]]
    for rows in batches:
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.mode("append").parquet(source)
        query = refresh_stream(spark.readStream.schema(CHANGES).parquet(source), store, str(tmp_path / "cp")).queryName(f"q{uuid.uuid4().hex}").trigger(availableNow=True).start()
        query.awaitTermination()
    assert held(store)[0] == replay(batches)[0]
