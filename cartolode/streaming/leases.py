"""Leases on files and folders: claims, contention, releases and expiry, as a stream with event-time timers and as a sweep."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from cartolode.functions.scalar import ancestors
from cartolode.operators.ordered import running
from cartolode.sources.tables import save

LEASES = "repo string, id string, at timestamp, event string, agent string, target string, contenders long"
NEVER = (1 << 63) - 1


def _overlap(a: str, b: str) -> bool:
    return a == b or b.startswith(a + "/") or a.startswith(b + "/")


class _Leases(StatefulProcessor):
    """Keeps a repository's claims by id. A claim's timer fires when the watermark passes its expiry."""

    def init(self, handle) -> None:
        self.handle = handle
        self.claims = handle.getMapState("claims", "id string", "agent string, target string, claimed long, expires long")

    def _held(self) -> list[tuple]:
        return [(k[0], *v) for k, v in self.claims.iterator()]

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802 - the name is Spark's
        out = []
        every = pd.concat(list(rows))
        every[["id", "agent", "target"]] = every[["id", "agent", "target"]].astype(object).where(every[["id", "agent", "target"]].notna(), None)
        for r in sorted(every.itertuples(index=False), key=lambda r: (r.at, r.action, r.id or "")):
            now = int(pd.Timestamp(r.at).value // 1_000_000)
            held = [c for c in self._held() if c[3] <= now < c[4]]
            if r.action == "claim":
                expires = NEVER if pd.isna(r.expires_at) else int(pd.Timestamp(r.expires_at).value // 1_000_000)
                others = sum(c[1] != r.agent and _overlap(c[2], r.target) for c in held)
                out.append((key[0], r.id, r.at, "claimed", r.agent, r.target, others))
                self.claims.updateValue((r.id,), (r.agent, r.target, now, expires))
                if expires != NEVER:
                    self.handle.registerTimer(expires)
            else:
                for c in held:
                    if c[0] == r.id if r.id is not None else (r.target in (None, c[2]) and r.agent in (None, c[1]) and not r.target is r.agent is None):
                        out.append((key[0], c[0], r.at, "released", c[1], c[2], 0))
                        self.claims.removeKey((c[0],))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in LEASES.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed, out = expiredTimerInfo.getExpiryTimeInMs(), []
        for i, agent, target, _, expires in self._held():
            if expires <= passed:
                out.append((key[0], i, pd.Timestamp(expires, unit="ms"), "expired", agent, target, 0))
                self.claims.removeKey((i,))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in LEASES.split(", ")])

    def close(self) -> None:
        pass


def watch_leases(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A stream of events(repo, id, at, action, agent, target, expires_at) to LEASES: each claim with how many active claims of
    other agents it meets on the same target, one above or one below, each release and each expiry.

    action is claim, or release: by id; else by target, of one agent or of all; else of all an agent's claims. A claim without
    expires_at never expires; one whose expiry has come is not released any more. Events of a batch go by time, claims
    before releases, then by id; those later than the watermark are dropped. The stream needs the RocksDB state store.
    """
    timed = events.withColumn("at", F.col("at").cast("timestamp")).withColumn("expires_at", F.col("expires_at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("repo").transformWithStateInPandas(_Leases(), LEASES, "Append", "EventTime")


def ended(events: DataFrame) -> DataFrame:
    """The claims among events, each with end and ending: the first release that names it, before its expiry, or its expiry;
    both null if it is held for ever. Claims and releases of one key are read once, backwards in time."""
    claims = events.where("action = 'claim'").drop("action")
    released = []
    given = events.where("action = 'release'")
    ways = ((["repo", "id"], "id is not null"), (["repo", "target", "agent"], "id is null and target is not null and agent is not null"), (["repo", "target"], "id is null and target is not null and agent is null"), (["repo", "agent"], "id is null and target is null and agent is not null"))
    for keys, named in ways:
        both = claims.select(*keys, F.col("id").alias("claim"), "at", F.lit(0).alias("release")).unionByName(given.where(named).select(*keys, F.lit(None).cast(claims.schema["id"].dataType).alias("claim"), "at", F.lit(1).alias("release")))
        since = Window.partitionBy(*keys).orderBy(F.desc("at"), F.desc("release")).rowsBetween(Window.unboundedPreceding, 0)
        released.append(both.withColumn("end", F.min(F.when(F.col("release") == 1, F.col("at"))).over(since)).where("release = 0 and end is not null").select("repo", F.col("claim").alias("id"), "end"))
    first = reduce(DataFrame.unionByName, released).groupBy("repo", "id").agg(F.min("end").alias("released"))
    rows = claims.join(first, ["repo", "id"], "left")
    left = F.col("expires_at").isNull() | (F.col("released") < F.col("expires_at"))
    ending = F.when(F.col("released").isNotNull() & left, "released").when(F.col("expires_at").isNotNull(), "expired")
    return rows.select("repo", "id", "agent", "target", "at", F.when(ending == "released", F.col("released")).otherwise(F.col("expires_at")).alias("end"), ending.alias("ending"))


def contention(claims: DataFrame) -> DataFrame:
    """claims of ended() with contenders: the active claims of other agents that each meets when it is made.

    A sweep over the starts and ends in order of time: at every place running sums say how many claims are active on it and
    below it, over all agents and of each one. A claim asks at its own target and at those above it, so that no pairs of
    claims are formed, and the sums are taken by ranges of the order, so that no place is gathered in one task.
    """
    # Claims and steps are read many times over, and ranges are told from a pass of their own: each is written once.
    c = save(claims.select("repo", "id", "agent", "target", "at", "end", "ending"), "claims")
    above = F.slice(ancestors(F.col("target")), 2, 1 << 20)
    on = F.struct(F.col("target").alias("place"), F.lit(False).alias("below"))
    held = F.concat(F.array(on), F.transform(above, lambda p: F.struct(p.alias("place"), F.lit(True).alias("below"))))
    asked = F.concat(F.array(F.struct(F.col("target").alias("place"), F.lit(True).alias("below"))), F.transform(ancestors(F.col("target")), lambda p: F.struct(p.alias("place"), F.lit(False).alias("below"))))
    # At one time expiries come first, then each claim's question before its start, then releases.
    step = lambda places, time, phase, part, n: c.where(time.isNotNull()).select("repo", "agent", "id", F.explode(places).alias("x"), time.alias("time"), phase.alias("phase"), F.lit(part).alias("part"), F.lit(n).cast("long").alias("n"))
    after = F.when(F.col("end") >= F.col("at"), F.col("end"))
    steps = step(asked, F.col("at"), F.lit(1), 0, 0).unionByName(step(held, F.col("at"), F.lit(1), 1, 1)).unionByName(step(held, after, F.when(F.col("ending") == "released", 2).otherwise(0), 2, -1))
    # A claim that has expired when it is made is never active.
    dead = c.where("ending = 'expired' and end <= at").select("repo", "id")
    steps = steps.select("repo", "agent", "id", "x.place", "x.below", "time", "phase", "part", "n").join(dead.withColumn("dead", F.lit(True)), ["repo", "id"], "left").where("dead is null or part = 0").drop("dead")
    steps = save(steps, "steps")
    order = ["time", "phase", "id", "part"]
    every = save(running(steps, order, F.col("n"), "every", ("repo", "place", "below")), "every")
    summed = running(every, order, F.col("n"), "own", ("repo", "place", "below", "agent"))
    met = summed.where("part = 0").groupBy("repo", "id").agg(F.sum(F.col("every") - F.col("own")).alias("contenders"))
    return c.join(met, ["repo", "id"])


def lease_log(events: DataFrame, until: str | None = None) -> DataFrame:
    """The batch twin of watch_leases: LEASES of events, with the expiries up to a time, by default the last event's. Ids of claims
    are unique in a repository."""
    rows = save(contention(ended(events)), "leases")
    last = F.lit(until).cast("timestamp") if until else F.lit(events.agg(F.max("at")).first()[0])
    claimed = rows.select("repo", "id", "at", F.lit("claimed").alias("event"), "agent", "target", "contenders")
    gone = rows.where((F.col("ending") == "released") | (F.col("end") <= last))
    return claimed.unionByName(gone.select("repo", "id", F.col("end").alias("at"), F.col("ending").alias("event"), "agent", "target", F.lit(0).cast("long").alias("contenders")))
