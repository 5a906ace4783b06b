"""SimHash near-duplicates by the similarity of word shingles: covering masks propose, wide fingerprints sort out, exact
shingle sets confirm."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, small, text_batches, trimmed
from .components import connected_components
from .simhash import RADIUS, SEED, covering_masks, signed

WORDS, SIMILARITY = 5, 0.8
#: A fingerprint has WIDE words of 64 bits. The covering masks lie over the first MASKED bits of each word, so that every
#: pair that differs in at most RADIUS of them in some word meets. At similarity 0.8 a bit differs with probability 0.15 and
#: a mask keeps 23 bits: each of the 240 masks brings a pair together with probability 0.02. In a simulation of 200 pairs each
#: 95.5 % meet at similarity 0.8, and all at 0.85 and 0.9. Two texts that have nothing in common meet under a mask with
#: probability 2^-23.
WIDE, MASKED = 16, 44
#: Shares of bits that may differ beyond what the similarity lets expect.
SLACK = 0.08
#: Of 64 bits of two further words, more than so many differ for texts that share a bucket by chance in 992 of 1000 cases, and
#: for texts of similarity 0.8, whose mean is 9.5 bits, in less than one of 10^5.
CHANCE = 22
#: Texts are counted by so many values of a byte of their shingles' hashes; two texts share at most what the counts share.
BINS = 256
#: Those that meet are compared in blocks of so many texts, every two of which meet in a task. What would be more than BLOCKS of
#: them is dealt into BLOCKS larger ones, of MOST texts at most, so that a text has no more than BLOCKS rows until then.
BLOCK, BLOCKS, MOST = 256, 32, 8192
#: Components of so many texts are met as a whole by those of other components, not in every bucket, if a text's buckets with them
#: hold at least the HOME-th part of their texts.
LARGE, HOME = 64, 8
#: Rows of a text and a bucket that a task makes or reads, those that it looks at together, and in a batch.
TASK_ROWS, CHUNK, BATCH = 720_000, 1 << 18, 1 << 14
#: Words of a fingerprint whose buckets link texts first, and those whose buckets are shuffled at a time.
FIRST, AT_ONCE = 2, 4
#: Every two texts of a bucket of so many are told apart by two further words; of a larger one those outside its largest component,
#: if they are no more, from all.
ALIKE = 1024
_RANDOM = np.random.default_rng(SEED)
_START, _TURN = (_RANDOM.integers(0, 1 << 63, WIDE, np.uint64) for _ in range(2))
_TURN = 2 * _TURN + np.uint64(1)
#: The bits of each byte value.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_set(words: list[bytes], width: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text with fewer words is one shingle, an empty one has none."""
    if not words:
        return np.zeros(0, np.uint64)
    parts = map(b" ".join, zip(*(words[k:] for k in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), np.uint64))


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= least * (len(a) + len(b) - shared) - 1e-9


def _tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _node(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words), SEED) - (1 << 63)


def wide_print(shingles: np.ndarray) -> np.ndarray:
    """WIDE words; a bit is one if set in over half of the shingles' hashes for that word."""
    counts = np.zeros((WIDE * 8, 256), np.int64)
    column = np.arange(WIDE * 8) << 8
    for at in range(0, len(shingles), 2048):
        x = (shingles[at : at + 2048, None] ^ _START) * _TURN
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        counts += np.bincount((x.view(np.uint8) + column).ravel(), minlength=WIDE * 8 << 8).reshape(counts.shape)
    ones = (counts @ _BITS).reshape(WIDE, 64)
    return np.packbits(2 * ones > len(shingles), axis=1, bitorder="little").view("<u8")[:, 0]


def byte_counts(shingles: np.ndarray) -> np.ndarray:
    """How many of the hashes have each first byte, 255 for more."""
    return np.minimum(np.bincount((shingles >> np.uint64(56)).astype(np.int64), minlength=BINS), 255).astype(np.uint8)


def may_share(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, least: float) -> np.ndarray:
    """Whether sets with the byte_counts a and b, of so many elements together, can have the similarity: never false where they have it."""
    common = np.minimum(a, b)
    return (common.sum(-1, dtype=np.int64) * (1 + least) >= least * sizes - 1e-6) | (common == 255).any(-1)


def _prints(width: int):
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, nodes = np.zeros((b.num_rows, WIDE), np.uint64), np.zeros(b.num_rows, np.int64)
            bins, sizes = [], np.zeros(b.num_rows, np.int64)
            for k, t in enumerate(b.column(1)):
                words = _tokens(t.as_py())
                held = shingle_set(words, width)
                made[k], nodes[k], sizes[k] = wide_print(held), _node(words), len(held)
                bins.append(byte_counts(held).tobytes())
            wide = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * WIDE), pa.array(made.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes), wide, pa.array(bins, pa.binary()), pa.array(sizes)], ["doc_id", "node", "wide", "bins", "size"])

    return prints


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([_node(_tokens(t.as_py())) for t in b.column(0)], pa.int64()), b.column(0)], ["node", "t"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of rows that arrive in order of their bucket, the first column, so many at a time and whole buckets only."""
    held, count, most = [], 0, CHUNK
    for b in batches:
        held.append([c.to_numpy() for c in b.columns])
        count += b.num_rows
        if count < most:
            continue
        columns = [np.concatenate(c) for c in zip(*held)]
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        if cut:
            yield [c[:cut] for c in columns]
        held, count = [[c[cut:] for c in columns]], count - cut
        most = max(CHUNK, 2 * count)
    if count:
        yield [np.concatenate(c) for c in zip(*held)]


def _starts(bucket: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])[: len(bucket)]


def _sizes(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.r_[starts, n])


def _shared(columns: list[np.ndarray]) -> list[np.ndarray]:
    """The rows (bucket, node, ...) whose bucket has others, in order of bucket and node."""
    same = columns[0][1:] == columns[0][:-1]
    columns = [c[np.r_[same, False] | np.r_[False, same]] for c in columns]
    order = np.lexsort((columns[1], columns[0]))
    return [c[order] for c in columns]


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sketches are alike enough for texts that did not meet by chance."""
    return np.bitwise_count((a ^ b).view(np.uint64)) <= CHANCE


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (bucket, node, root, sketch) in order of bucket the pairs of a node and the first of its bucket, if alike."""
    for columns in _whole(batches):
        bucket, node, _, sketch = _shared(columns)
        starts = _starts(bucket)
        first = np.repeat(starts, _sizes(starts, len(bucket)))
        ok = (node != node[first]) & _near(sketch, sketch[first])
        yield pa.RecordBatch.from_arrays([pa.array(node[ok]), pa.array(node[first][ok])], ["a", "b"])


def _strangers(bucket: np.ndarray, root: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Which rows, in order of bucket, are alike one of their bucket with another root."""
    starts = _starts(bucket)
    sizes = _sizes(starts, len(bucket))
    kept = np.repeat(sizes > ALIKE, sizes)
    left, lag = np.flatnonzero(~kept[:-1]), 1
    while len(left := left[(left + lag < len(bucket)) & (bucket[left] == bucket[np.minimum(left + lag, len(bucket) - 1)])]):
        at = left[(root[left] != root[left + lag]) & _near(sketch[left], sketch[left + lag])]
        kept[at] = kept[at + lag] = True
        lag += 1
    for start, n in zip(starts[sizes > ALIKE], sizes[sizes > ALIKE]):
        own, at = root[start : start + n], slice(start, start + n)
        values, counts = np.unique(own, return_counts=True)
        others = np.flatnonzero(own != values[counts.argmax()])
        if len(others) > ALIKE:
            continue
        kept[at] = False
        for k in others:
            alike = (own != own[k]) & _near(sketch[at], sketch[start + k])
            kept[start + k] |= alike.any()
            kept[at] |= alike
    return kept


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (bucket, node, root, sketch) in order of bucket, a root of zero being none, those of buckets of one root, and of
    others those alike one of their bucket with another root: (bucket, node, n, rep, ray). n is how many of the bucket these are, rep
    the first of them, and ray whether a node is alike rep and of another root; n is zero for a bucket of one root."""
    for columns in _whole(batches):
        bucket, node, root, sketch = _shared(columns)
        root = np.where(root == 0, node, root)
        starts = _starts(bucket)
        if not len(starts):
            continue
        mixed = np.repeat(np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts), _sizes(starts, len(bucket)))
        ok = ~mixed
        at = np.flatnonzero(mixed)
        if len(at):
            ok[at] = _strangers(bucket[at], root[at], sketch[at])
        bucket, node, root, sketch, mixed = (c[ok] for c in (bucket, node, root, sketch, mixed))
        starts = _starts(bucket)
        n = _sizes(starts, len(bucket))
        first = np.repeat(starts, n)
        ray = (root != root[first]) & _near(sketch, sketch[first])
        out = [bucket, node, np.where(mixed, np.repeat(n, n), 0), node[first], ray]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["bucket", "node", "n", "rep", "ray"])


def _words(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().view(np.uint64).reshape(-1, WIDE)


def _bins(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def most_bits(least: float) -> int:
    """The most bits in which texts of this similarity are taken to differ, of sets of one size."""
    return int(64 * WIDE * (math.acos(2 * least / (1 + least)) / math.pi + SLACK))


def _likely(least: float):
    """The pairs whose fingerprints differ in no more bits than the similarity allows and whose counts can share enough."""

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wide, bins, sizes = ([b.column(f"{c}{k}") for k in "ab"] for c in ("wide_", "bins_", "size_"))
            apart = np.bitwise_count(_words(wide[0]) ^ _words(wide[1])).sum(1)
            ok = (apart <= most_bits(least)) & may_share(_bins(bins[0]), _bins(bins[1]), sizes[0].to_numpy() + sizes[1].to_numpy(), least)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return likely


def _across(least: float):
    """Likely pairs of different components, as in _likely, within each block pair; a block meets itself where both sides are one. Rows
    arrive in order of the meeting, and one meeting at a time is held."""

    def pairs(part: pa.Table) -> pa.RecordBatch:
        node, root, side, size = (part.column(c).to_numpy() for c in ("node", "root", "side", "size"))
        wide, bins = _words(part.column("wide").combine_chunks()), _bins(part.column("bins"))
        left, right, found = np.flatnonzero(side != 1), np.flatnonzero(side != 0), []
        for i in left:
            others = right[(root[right] != root[i]) & ((side[i] == 0) | (node[right] > node[i]))]
            others = others[np.bitwise_count(wide[others] ^ wide[i]).sum(1) <= most_bits(least)]
            others = others[may_share(bins[others], bins[i], size[others] + size[i], least)]
            found += [(node[i], node[j]) for j in others]
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            meet = b.column("meet").to_numpy()
            ends = [*(np.flatnonzero(meet[1:] != meet[:-1]) + 1).tolist(), len(meet)]
            at = 0
            for end in ends:
                if held and end > at and held[0].column("meet")[0].as_py() != meet[at]:
                    yield pairs(pa.Table.from_batches(held))
                    held = []
                if end > at:
                    held.append(b.slice(at, end - at))
                at = end
        if held:
            yield pairs(pa.Table.from_batches(held))

    return across


def _confirm(width: int, least: float):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = lru_cache(64)(lambda text: shingle_set(_tokens(text), width))
        for b in batches:
            ok = [similar(shingles(s.as_py()), shingles(t.as_py()), least) for s, t in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return confirm


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, least: float = SIMILARITY) -> DataFrame:
    """One row per document: (doc_id, component_id), the smallest doc_id reachable by pairs of texts whose sets of
    word shingles have at least the Jaccard similarity `least`.

    Texts of the same words are one node. Texts whose fingerprints agree under a covering mask share a bucket. By the buckets of a
    few words each text is first compared with the first of all texts that its buckets begin with, a pair a text; then with the
    first of each. After that rows of all buckets are dealt, some words at a time, and only texts that are alike one of another
    component in their bucket go on, not those that met by chance nor those of one component. They are
    compared with the first of their buckets, and all other pairs of a bucket that this left in different components in blocks. A
    large component is not met in every bucket: a text that shares many with it is compared with all of its texts, once. Every link
    is confirmed on the exact sets.

    Null and empty texts are one group; a null id is no candidate for component_id, which is null if its whole
    component has none; an empty table gives no rows.
    """
    with text_batches(docs.sparkSession):
        return _similar_groups(docs, id_col, text_col, width, least)


def _similar_groups(docs: DataFrame, id_col: str, text_col: str, width: int, least: float) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("t"))
    prints = save(rows.mapInArrow(trimmed(_prints(width)), "doc_id long, node long, wide array<long>, bins binary, size long"), "prints")
    classes = save(prints.groupBy("node").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("wide", "bins", "size")]), "classes")
    texts = classes.count()
    masks = covering_masks(list(range(MASKED)), RADIUS)
    next_ = lambda n: F.element_at("wide", F.pmod(F.col("w") + n, F.lit(WIDE)) + 1).bitwiseAND(F.lit((1 << 32) - 1))
    sketch = F.shiftleft(next_(1), 32).bitwiseOR(next_(2)).alias("sketch")

    def dealt(nodes: DataFrame, low: int, high: int, task, schema: str) -> DataFrame:
        """What task makes of the rows of nodes(node, root, wide) for the masks over these words, which arrive in order of bucket."""
        # A text has a row for every mask: tasks take few enough texts that none spills.
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-texts * (high - low) * len(masks) // TASK_ROWS))
        words = nodes.repartition(parts, "node").select("node", "root", "wide", F.posexplode("wide").alias("w", "x")).where(F.col("w").between(low, high - 1))
        words = words.select("node", "root", "w", "x", sketch)
        rows = words.select(F.explode(F.array(*[F.xxhash64(F.lit(k), "w", F.col("x").bitwiseAND(F.lit(signed(m)))) for k, m in enumerate(masks)])).alias("bucket"), "node", "root", "sketch")
        with text_batches(docs.sparkSession, BATCH):
            return save(rows.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(task), schema), "shared")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        pairs = save(pairs.distinct(), f"{name}-pairs")
        wanted = small(save(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), f"{name}-wanted"))
        texts = save(rows.select("t").mapInArrow(trimmed(_named), "node long, t binary").join(wanted, "node", "left_semi").groupBy("node").agg(F.first("t").alias("t")), f"{name}-texts")
        sides = [texts.select(F.col("node").alias(k), F.col("t").alias(f"t{k}")) for k in ("a", "b")]
        return save(pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "ta", "tb").mapInArrow(trimmed(_confirm(width, least)), "a long, b long"), f"{name}-links")

    def likely(pairs: DataFrame) -> DataFrame:
        for k in ("a", "b"):
            pairs = pairs.join(classes.select(F.col("node").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("wide", "bins", "size")]), k)
        return pairs.mapInArrow(trimmed(_likely(least)), "a long, b long")

    def components(links: DataFrame) -> DataFrame:
        return save(connected_components(links).withColumnRenamed("component", "root"), "roots")

    def rays(met: DataFrame) -> DataFrame:
        """The pairs (a, b) of different components."""
        met = met.distinct()
        for k in ("a", "b"):
            met = met.join(roots.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}")), k, "left")
        return save(met.where("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b"), "rays")

    first = dealt(classes.select("node", F.lit(0).cast("long").alias("root"), "wide"), 0, FIRST, _stars, "a long, b long")
    links = confirmed(likely(save(first.groupBy("a").agg(F.min("b").alias("b")), "stars")), "star")
    roots = components(links)
    links = save(links.union(confirmed(likely(rays(first)), "first-ray")), "links")
    roots = components(links)
    nodes = save(classes.select("node", "wide").join(roots, "node", "left").select("node", F.coalesce("root", F.lit(0).cast("long")).alias("root"), "wide"), "nodes")
    parts = [dealt(nodes, k, min(k + AT_ONCE, WIDE), _members, "bucket long, node long, n long, rep long, ray boolean") for k in range(0, WIDE, AT_ONCE)]
    members = save(reduce(DataFrame.unionByName, parts), "members")
    links = save(links.union(confirmed(likely(rays(members.where("ray").select(F.col("node").alias("a"), F.col("rep").alias("b")))), "ray")), "links")
    roots = components(links)
    # Every text has met the first of its buckets: the others are left, which are two at least in buckets of three.
    held = save(roots.join(save(roots.groupBy("root").agg(F.count("*").alias("held")), "held"), "root").select("node", "root", "held"), "held")
    rest = members.where("n > 2 and node <> rep").select("bucket", "node", "n", "rep")
    large = small(held.where(F.col("held") >= LARGE))
    # A bucket's home is the largest of the large components of three of its texts, the last and the first two: no row is formed for
    # each text of a large component and bucket. Which home a bucket has, or that it has none, changes where its texts are met only.
    known = rest.groupBy("bucket").agg(F.first("rep").alias("rep"), F.min("node").alias("first"), F.max("node").alias("last"))
    known = known.select("bucket", F.explode(F.array_distinct(F.array("rep", "first", "last"))).alias("known"))
    tops = known.join(large.withColumnRenamed("node", "known"), "known").groupBy("bucket").agg(F.max(F.struct("held", "root")).alias("top"))
    tops = save(tops.select("bucket", F.col("top.root").alias("home"), F.col("top.held").alias("of")), "tops")
    rest = rest.drop("rep")
    loose = rest.join(tops, "bucket", "left").join(large.select("node", F.col("root").alias("home")), ["node", "home"], "left_anti")
    loose = loose.join(held.select("node", "root"), "node", "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("root"), "home", "of")
    loose = save(loose, "loose")
    mixed = loose.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("home").alias("home"))
    mixed = small(save(mixed.where("low <> high or home is not null").select("bucket"), "mixed"))
    left = save(loose.join(mixed, "bucket", "left_semi"), "left")
    guests = save(left.where("home is not null").groupBy("node", "root", "home", "of").agg((F.sum("n") * HOME >= F.col("of")).alias("often")), "guests")
    seldom = left.join(guests.where("not often").select("node", "home"), ["node", "home"], "left_semi").select("bucket", "home", "n").distinct()
    seldom = small(save(seldom, "seldom")).withColumnRenamed("home", "root")
    # The texts at home in such buckets: those that are not loose there.
    hosts = rest.select("bucket", "node").join(seldom, "bucket").join(large.select("node", "root"), ["node", "root"], "left_semi").select("bucket", "node", "root", "n")
    left = save(left.select("bucket", "node", "root", "n").unionByName(hosts), "left")

    def blocks(n: Column) -> Column:
        return F.greatest(F.least(F.ceil(n / BLOCK), F.lit(BLOCKS)), F.ceil(n / MOST)).cast("long")

    def block(n: str) -> Column:
        return F.pmod(F.xxhash64("node"), blocks(F.col(n)))

    def each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), blocks(F.col(n)) - 1)).alias("other")

    low, high = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") == low, 0).otherwise(1).alias("side")
    meets = left.select("bucket", "node", "root", block("n").alias("block"), each("n")).select("node", "root", F.xxhash64("bucket", low, high).alias("meet"), side)
    guests = guests.where("often").select("node", "root", "home", "of")
    sizes = small(save(guests.groupBy("home", "of").agg(F.count("*").alias("n")), "homes"))
    come = guests.join(sizes.select("home", "n"), "home").select("node", "root", "home", block("n").alias("block"), each("of"))
    stay = held.select("node", "root").join(sizes, F.col("root") == F.col("home")).select("node", "root", "home", block("of").alias("block"), each("n"))
    for part, (x, y), at in ((come, ("block", "other"), 0), (stay, ("other", "block"), 1)):
        meets = meets.unionByName(part.select("node", "root", F.xxhash64("home", x, y, F.lit(0)).alias("meet"), F.lit(at).alias("side")))
    met = save(meets, "meets").join(classes.select("node", "wide", "bins", "size"), "node").repartition("meet").sortWithinPartitions("meet")
    links = save(links.union(confirmed(met.mapInArrow(trimmed(_across(least)), "a long, b long"), "across")), "links")
    roots = components(links)
    ends = save(classes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "ends")
    named = save(ends.join(save(ends.groupBy("root").agg(F.min("least").alias("component_id")), "least"), "root").select("node", "component_id"), "named")
    return prints.select("doc_id", "node").join(named, "node").select("doc_id", "component_id")
