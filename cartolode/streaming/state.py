"""Streams that keep state: changes of a snapshot, costs, leases, and the scope guard."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from cartolode.functions.scalar import ancestors

DELTAS = "key string, at timestamp, dimension string, added long, removed long"


class _Deltas(StatefulProcessor):
    """Keeps the last snapshot of a key, its members by dimension, and tells what came and went."""

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "members array<string>")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802 - the name is Spark's
        before = set(self.last.get()[0]) if self.last.exists() else set()
        out = []
        every = pd.concat(list(rows)).sort_values("at")
        for at, members in zip(every["at"], every["members"]):
            now = set(members)
            for d in sorted({m.split(":", 1)[0] for m in now ^ before}):
                side = lambda s, d=d: sum(m.split(":", 1)[0] == d for m in s)
                out.append((key[0], at, d, side(now - before), side(before - now)))
            before = now
        self.last.update((sorted(before),))
        if out:
            yield pd.DataFrame(out, columns=["key", "at", "dimension", "added", "removed"])

    def close(self) -> None:
        pass


def watch_deltas(snapshots: DataFrame) -> DataFrame:
    """A stream of snapshots(key, at, members), members named `dimension:item`, to what was added and removed by dimension,
    with rows only where something changed. The stream needs the RocksDB state store."""
    return snapshots.groupBy("key").transformWithStateInPandas(_Deltas(), DELTAS, "Append", "None")


def snapshot_deltas(snapshots: DataFrame) -> DataFrame:
    """The batch twin of watch_deltas, with one snapshot for each key and time."""
    before = F.coalesce(F.lag("members").over(Window.partitionBy("key").orderBy("at")), F.array().cast("array<string>"))
    rows = snapshots.withColumn("before", before)
    side = lambda a, b, n: rows.select("key", "at", F.explode(F.array_except(a, b)).alias("m"), F.lit(n).alias("side"))
    moved = side("members", "before", "added").unionByName(side("before", "members", "removed"))
    return moved.groupBy("key", "at", F.substring_index("m", ":", 1).alias("dimension")).agg(F.count_if(F.col("side") == "added").alias("added"), F.count_if(F.col("side") == "removed").alias("removed"))


COST_DELTAS = "tool string, tick long, calls_added long, tokens_added long, calls long, tokens long"


class _CostDeltas(StatefulProcessor):
    """Keeps a tool's last tick and calls. What is kept goes when the tool is absent from a tick, and from the store after a while."""

    def __init__(self, kept_ms: int):
        self.kept_ms = kept_ms

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "tick long, calls long", self.kept_ms)

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802 - the name is Spark's
        tick, before = self.last.get() if self.last.exists() else (None, 0)
        every, out = pd.concat(list(rows)).sort_values("tick"), []
        for now, calls, tokens in zip(every["tick"].tolist(), every["calls"].tolist(), every["tokens"].tolist()):
            before = before if tick == now - 1 else 0
            if calls > before:
                out.append((key[0], now, calls - before, max(0, tokens - int(tokens / calls * before + 0.5)), calls, tokens))
            tick, before = now, calls
        self.last.update((tick, before))
        if out:
            yield pd.DataFrame(out, columns=["tool", "tick", "calls_added", "tokens_added", "calls", "tokens"])

    def close(self) -> None:
        pass


def watch_costs(ticks: DataFrame, kept_ms: int = 3_600_000) -> DataFrame:
    """A stream of ticks(tool, tick, calls, tokens), the totals of a bounded log at numbered times, to what each tool added where
    it added calls; fewer calls than before only set the ground for the next tick. The tokens added are what the tick's mean
    leaves beyond the calls known before. A tool that was absent from the last tick begins anew, and is forgotten after
    kept_ms. The stream needs the RocksDB state store."""
    return ticks.groupBy("tool").transformWithStateInPandas(_CostDeltas(kept_ms), COST_DELTAS, "Append", "ProcessingTime")


def cost_deltas(ticks: DataFrame) -> DataFrame:
    """The batch twin of watch_costs."""
    order = Window.partitionBy("tool").orderBy("tick")
    rows = ticks.withColumn("before", F.when(F.lag("tick").over(order) == F.col("tick") - 1, F.lag("calls").over(order)).otherwise(0))
    known = F.floor(F.col("tokens") / F.col("calls") * F.col("before") + 0.5)
    rows = rows.where(F.col("calls") > F.col("before"))
    return rows.select("tool", "tick", (F.col("calls") - F.col("before")).alias("calls_added"), F.greatest(F.lit(0), F.col("tokens") - known).cast("long").alias("tokens_added"), "calls", "tokens")


def claims_active(claims: DataFrame, now: str, releases: DataFrame | None = None) -> DataFrame:
    """claims(id, agent, target, claimed_at, expires_at) that hold at a time: made by then, not expired (a null expiry never
    is), and not in releases(id)."""
    rows = claims.where((F.col("claimed_at") <= F.lit(now).cast("timestamp")) & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp"))))
    return rows if releases is None else rows.join(releases.select("id").distinct(), "id", "left_anti")


def guard_stream(changed: DataFrame, contract: DataFrame) -> DataFrame:
    """changed(contract_id, path), a stream or a table, with the scope of each row under a static contract(contract_id, prefix,
    kind): forbidden below a forbidden place, else allowed below an allowed one or without any, else outside."""
    rules = contract.groupBy("contract_id").agg(*[F.collect_set(F.when(F.col("kind") == k, F.col("prefix"))).alias(k) for k in ("forbidden", "allowed")])
    rows = changed.join(rules, "contract_id", "left")
    none = F.array().cast("array<string>")
    below = lambda k: F.arrays_overlap(ancestors(F.col("path")), F.coalesce(k, none))
    scope = F.when(below("forbidden"), "forbidden").when(below("allowed") | (F.size(F.coalesce("allowed", none)) == 0), "allowed").otherwise("outside")
    return rows.withColumn("scope", scope).drop("forbidden", "allowed")
