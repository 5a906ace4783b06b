"""Periodic runs of words: multi-scale minimizers seed the long periods, direct lag scans cover the short ones.

Inside a run of period q every window looks like the one q words on, so both choose the same least gram. For periods from
2k to 4k words the windows are of k grams of k words; two equal choices at such a distance seed an extension at that lag.
A gram that lies in a run of a period up to k / 3 is never chosen: a run of a longer period is not made of such grams alone,
and other equal grams are more than k / 3 words apart, so that a choice has at most twelve partners within 4k words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, table, text_batches
from .passages import Rolling

LEAST, TIMES = 24, 3
#: Periods below this are found by comparing all words with those so many words on; grams of the first scale have half as many.
SHORT = 48
#: Bytes of text that a task holds at once.
PIECE = 4 << 20
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _stretches(hits: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last of the stretches of at least need consecutive numbers."""
    if len(hits) < need:
        return hits[:0], hits[:0]
    head = np.flatnonzero(np.concatenate([[True], hits[1:] != hits[:-1] + 1]))
    size = np.diff(np.append(head, len(hits)))
    long = size >= need
    return hits[head[long]], hits[head[long]] + size[long]


def _same(x: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words from a and b on, forwards or backwards by step, are equal pair by pair."""
    n, size = 0, 64
    room = len(x) - b if step > 0 else a + 1
    while n < room:
        size = min(size, room - n)
        if step > 0:
            differs = np.flatnonzero(x[a + n : a + n + size] != x[b + n : b + n + size])
        else:
            differs = np.flatnonzero(x[a - n - size + 1 : a - n + 1][::-1] != x[b - n - size + 1 : b - n + 1][::-1])
        if len(differs):
            return n + int(differs[0])
        n, size = n + size, 2 * size
    return n


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """The least or largest value, as pick says, of each window, by windows of doubling widths."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out, have = pick(out[:-step], out[step:]), have + step
    return out


def choices(values: np.ndarray, width: int) -> np.ndarray:
    """Places whose value is the least of some window that holds them; equal least values of a window are all chosen."""
    pad = np.zeros(width - 1, values.dtype)
    return np.flatnonzero(_sliding(np.concatenate([pad, _sliding(values, width, np.minimum), pad]), width, np.maximum) == values)


def _seeds(x: np.ndarray, k: int, runs: dict) -> np.ndarray:
    """Pairs (lag, place), sorted, of equal choices at a lag of 2k to 4k - 1."""
    grams = Rolling(x.view(np.uint64)).grams(k)
    if len(grams) < k:
        return np.zeros((0, 2), np.int64)
    step = np.zeros(len(grams) + 1, np.int64)
    for (start, end), period in runs.items():
        if 3 * period <= k <= end - start:
            step[start] += 1
            step[end - k + 1] -= 1
    grams[np.cumsum(step)[:-1] > 0] = _NEVER
    at = choices(grams, k)
    at = at[grams[at] != _NEVER]
    at = at[np.argsort(grams[at], kind="stable")]
    value, found, t = grams[at], [], 1
    while t < len(at):
        lag = at[t:] - at[:-t]
        near = (value[t:] == value[:-t]) & (lag < 4 * k)
        if not near.any():
            break
        seed = near & (lag >= 2 * k)
        found.append(np.stack([lag[seed], at[:-t][seed]], axis=1))
        t += 1
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    return pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """All runs (start, length, period) of each sequence of word numbers, by start, then period."""
    runs: dict[tuple[int, int], int] = {}
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size) - size
    x = np.concatenate([*texts, np.zeros(0, np.int64)]) | np.repeat(np.arange(len(texts), dtype=np.int64) << 32, size)
    for q in range(1, SHORT):
        if len(x) > q:
            for a, b in zip(*_stretches(np.flatnonzero(x[q:] == x[:-q]), max(LEAST, TIMES * q) - q)):
                runs.setdefault((int(a), int(b) + q), q)
    k = SHORT // 2
    while len(size) and TIMES * 2 * k <= size.max():
        long = np.flatnonzero(size >= TIMES * 2 * k)
        shift = begin[long] - (np.cumsum(size[long]) - size[long])
        part = np.concatenate([x[begin[i] : begin[i] + size[i]] for i in long])
        ends = np.cumsum(size[long])
        home = dict(zip(long.tolist(), shift.tolist()))
        mine = {}
        for (a, b), q in runs.items():
            by = home.get(int(np.searchsorted(begin, a, "right")) - 1)
            if by is not None:
                mine[a - by, b - by] = q
        last, upto = 0, 0
        for q, p in _seeds(part, k, mine).tolist():
            if q == last and p < upto:
                continue
            left, right = p - _same(part, p, p + q, -1) + 1, p + _same(part, p, p + q, 1)
            last, upto = q, max(right, p + 1)
            if right - left + q >= max(LEAST, TIMES * q):
                by = int(shift[np.searchsorted(ends, left, "right")])
                runs.setdefault((left + by, right + q + by), q)
        k *= 2
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (a, b), q in runs.items():
        i = int(np.searchsorted(begin, a, "right")) - 1
        out[i].append((a - int(begin[i]), b - a, q))
    return [sorted(r, key=lambda r: (r[0], r[2])) for r in out]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def piece(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        number = defaultdict(count().__next__)
        words = [t.split() for t in texts]
        runs = runs_of([np.array([number[x] for x in w], np.int64) for w in words])
        kept = []
        for w, found in zip(words, runs):
            if found:
                keep = np.ones(len(w), bool)
                for start, length, period in found:
                    keep[start + period : start + length] = False
                w = [x for x, k in zip(w, keep) if k]
            kept.append(b" ".join(w))
        structs = pa.array([[dict(zip(("start", "length", "period"), r)) for r in found] for found in runs], pa.list_(RUN))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(w) for w in words], pa.int64()), structs, pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "kept"]
        )

    ids, texts, held = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1)):
            ids.append(i), texts.append(t.as_buffer().to_pybytes() if t.is_valid else b"")
            held += len(texts[-1])
            if held >= PIECE:
                yield piece(ids, texts)
                ids, texts, held = [], [], 0
    if ids:
        yield piece(ids, texts)


def find_runs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, in no order: (doc_id, n_words, runs, kept). runs are all maximal runs of words (start, length,
    period), by start, then period; kept is the text without what any run repeats after its first period, joined by spaces.

    Each row is judged alone, so ids may repeat or be null. Null and empty texts have no words, no runs and an empty kept;
    other columns are ignored; an empty table gives no rows. One document has to fit in a task's memory.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(_found, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, kept string")


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period; ties go to the smallest start, then period; null if there is none."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.reduce(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def planted(text: Column, doc_id: Column) -> Column:
    """The text with a run written over its end, in the documents that the contract of op13 names; others stay as they are."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def made(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        over = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, place(i).cast("int"))), " ")
        return F.when(n > 0, over).otherwise(text)

    # As a lambda's argument the words are split once, not for each place.
    return F.when(h % 10 == 0, F.get(F.transform(F.array(words), made), F.lit(0))).otherwise(text)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))
    with text_batches(spark):
        found = find_runs(docs).withColumn("best", strongest(F.col("runs")))
        lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
        out = found.select(
            "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
            F.expr("1000L * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"),
        )
        return save(out, "runs")
