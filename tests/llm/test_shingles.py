"""Near-duplicates by shingle similarity against all pairs of exact sets: every link is right, what the masks guarantee is
found, and of the rest nearly all."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from cartolode.llm import common, shingles
from cartolode.llm.simhash import covering_masks


def edited(rnd, n=400):
    """Texts of 100 words with copies that differ in a few words, in chains; null, empty and short texts and repeats."""
    word = lambda: f"w{rnd.randrange(5000)}"
    texts = []
    for _ in range(n // 8):
        text = [word() for _ in range(100)]
        for _ in range(8):
            texts.append(" ".join(text))
            text = list(text)
            for _ in range(rnd.randint(1, 3)):
                text[rnd.randrange(100)] = word()
    texts += [None, "", " \t", "a b", "A  b", "a c", texts[0], texts[0].upper()]
    return list(enumerate(texts)) + [(None, texts[8]), (None, "only null id")]


def wanted(rows, found=lambda i, j: True):
    """The component of each row by links between sets of similarity 0.8 or more, those only that found takes; the sets; and
    the links between different sets."""
    sets = [frozenset(shingles.shingle_set((t or "").lower().encode().split()).tolist()) for _, t in rows]
    root, links = list(range(len(rows))), []

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (len(a & b) >= 0.8 * len(a | b) and found(i, j)):
                root[find(i)] = find(j)
                links += [(i, j)] if a != b else []
    least = {}
    for k, (d, _) in enumerate(rows):
        least[find(k)] = min((x for x in (d, least.get(find(k))) if x is not None), default=None)
    return [(d, least[find(k)]) for k, (d, _) in enumerate(rows)], sets, links


@pytest.mark.parametrize("block", [1024, 2])
def test_groups_link_pairs_of_similarity_0_8(spark, block, monkeypatch):
    monkeypatch.setattr(shingles, "BLOCK", block)
    rows = edited(random.Random(3))
    prints = [shingles.wide_print(shingles.shingle_set((t or "").lower().encode().split())) for _, t in rows]
    near = lambda i, j: (np.bitwise_count((prints[i] ^ prints[j]) & np.uint64((1 << shingles.MASKED) - 1)) <= 3).any()
    masks = np.array(covering_masks(list(range(shingles.MASKED)), 3), np.uint64)
    met = lambda i, j: ((prints[i] ^ prints[j])[:, None] & masks == 0).any()
    want, _, links = wanted(rows, met)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    got = [tuple(r) for r in shingles.similar_groups(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    every = wanted(rows)[2]
    assert all(met(i, j) for i, j in every if near(i, j)) and len(links) > 0.95 * len(every) > 250
    assert shingles.similar_groups(df.limit(0)).count() == 0


def group(rnd, n, most):
    """Texts of 100 words, each with up to so many words of the first one changed."""
    first = [f"w{rnd.randrange(5000)}" for _ in range(100)]
    texts = []
    for _ in range(n):
        text = list(first)
        for at in rnd.sample(range(100), rnd.randint(1, most)):
            text[at] = f"x{rnd.randrange(5000)}"
        texts.append(" ".join(text))
    return texts


def links_hold(rows, got, exactly=False):
    """Texts that share a bucket and are similar are in one component, and no others than are linked at all."""
    prints = [shingles.wide_print(shingles.shingle_set(t.encode().split())) for _, t in rows]
    masks = np.array(covering_masks(list(range(shingles.MASKED)), 3), np.uint64)
    least, every = (dict(wanted(rows, f)[0]) for f in (lambda i, j: ((prints[i] ^ prints[j])[:, None] & masks == 0).any(), lambda i, j: True))
    assert all(got[d] == got[c] and every[d] == every[got[d]] for d, c in least.items())
    assert not exactly or got == least


def test_a_large_group_of_near_copies_forms_few_pairs(spark, monkeypatch):  # pipeline
    """Some texts of the group are linked, others nearly: all meet, but not pair by pair."""
    counts, write = {}, shingles.save

    def save(df, name):
        df = write(df, name)
        counts[name] = max(counts.get(name, 0), df.count())
        return df

    monkeypatch.setattr(shingles, "save", save)
    rows = list(enumerate(group(random.Random(6), 500, 4)))
    links_hold(rows, dict(map(tuple, shingles.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    assert sum(n for name, n in counts.items() if name.endswith("-pairs")) < 20 * len(rows)


def test_a_large_component_forms_no_row_for_each_text_and_bucket(spark, monkeypatch):  # pipeline
    """The texts of one component share very many buckets: after these are counted, few rows of a text and a bucket are formed."""
    counts, write = {}, shingles.save

    def save(df, name):
        df = write(df, name)
        counts[name] = max(counts.get(name, 0), df.count())
        return df

    monkeypatch.setattr(shingles, "save", save)
    rows = list(enumerate(group(random.Random(9), 200, 2)))
    links_hold(rows, dict(map(tuple, shingles.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    late = sum(n for name, n in counts.items() if name not in ("shared", "members", "rays"))
    assert counts["members"] > 50 * len(rows) and 2 * late < counts["members"]


@pytest.mark.parametrize("home", [0, 8, 10**9])
def test_large_components_are_met_as_a_whole_or_in_buckets(spark, home, monkeypatch):
    """0: in buckets only; 10^9: as a whole only."""
    for name, value in (("LARGE", 3), ("HOME", home), ("BLOCK", 4), ("BLOCKS", 2), ("MOST", 16)):
        monkeypatch.setattr(shingles, name, value)
    rnd = random.Random(7)
    rows = list(enumerate(t for _ in range(3) for t in group(rnd, 60, 4)))
    links_hold(rows, dict(map(tuple, shingles.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())), home == 0)


def test_counts_never_deny_a_similar_pair():
    rng = np.random.default_rng(5)
    for n in (1, 5, 40, 300, 90_000):
        pool = np.unique(rng.integers(0, 1 << 63, 2 * n, np.int64).astype(np.uint64) * np.uint64(2))
        for share in (0.5, 0.7, 0.79, 0.8, 0.81, 0.9, 1):
            k = int(n * share)
            a, b = pool[:n], pool[n - k : 2 * n - k]
            may = shingles.may_share(shingles.byte_counts(a), shingles.byte_counts(b), len(a) + len(b), 0.8)
            assert may or not shingles.similar(a, b)
            assert not may or share > 0.5 or n in (1, 90_000)


def test_bits_differ_as_often_as_the_similarity_says():
    rng = np.random.default_rng(2)
    pool = np.unique(rng.integers(0, 1 << 63, 1400, np.int64)).astype(np.uint64)
    apart = np.bitwise_count(shingles.wide_print(pool[:1125]) ^ shingles.wide_print(pool[125:1250])).sum()
    assert 0.12 < apart / (64 * shingles.WIDE) < 0.18 and apart < shingles.most_bits(0.8)


def test_the_stage_drops_near_copies_of_similarity_0_8_to_0_97(spark):
    rnd, rows = random.Random(4), []
    for k in range(0, 60, 2):
        text = [f"w{rnd.randrange(5000)}" for _ in range(100)]
        other = list(text)
        for _ in range(rnd.randint(1, 2)):
            other[rnd.randrange(5, 95)] = "changed"
        rows += [(k, " ".join(text)), (k + 1, " ".join(other))]
    _, sets, _ = wanted(rows)
    assert all(0.8 <= len(a & b) / len(a | b) < 0.97 for a, b in zip(sets[::2], sets[1::2]))
    kept = corpus_pipeline.simhash_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 60, 2))


def test_a_written_table_leaves_no_shuffle_files(spark):  # F1
    files = lambda: {f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before = files()
    kept = common.save(spark.range(1000).repartition(4, "id").groupBy("id").count(), "kept")
    assert not files() - before and kept.count() == 1000


@pytest.mark.parametrize("alike", [1024, 3])
def test_texts_that_met_by_chance_are_not_written(monkeypatch, alike):  # F1
    """Against every pair of a bucket, for rows in batches and chunks that end anywhere."""
    monkeypatch.setattr(shingles, "CHUNK", 50)
    monkeypatch.setattr(shingles, "ALIKE", alike)
    rng = np.random.default_rng(8)
    n = 600
    bucket = np.sort(np.r_[rng.integers(-60, 60, n - 40), np.full(40, 7)])
    node, root = rng.permutation(n) - n // 2, rng.integers(0, 3, n)
    base = rng.integers(-(1 << 63), 1 << 63, 4)
    sketch = base[rng.integers(0, 4, n)] ^ (1 << rng.integers(0, 63, n))
    rows = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (bucket, node, root, sketch)], ["bucket", "node", "root", "sketch"])
    got = [r for b in shingles._members(iter([rows.slice(k, 17) for k in range(0, n, 17)])) for r in b.to_pylist()]
    own = [r or d for r, d in zip(root.tolist(), node.tolist())]
    near = lambda i, j: bin((int(sketch[i]) ^ int(sketch[j])) & (1 << 64) - 1).count("1") <= shingles.CHANCE
    want = []
    for b in sorted(set(bucket.tolist())):
        at = sorted(np.flatnonzero(bucket == b).tolist(), key=lambda k: node[k])
        if len(at) > 1:
            mixed = len({own[k] for k in at}) > 1
            at = [k for k in at if not mixed or any(own[k] != own[j] and near(k, j) for j in at)]
            want += [(b, int(node[k]), len(at) * mixed, int(node[at[0]]), own[k] != own[at[0]] and near(k, at[0])) for k in at]
    if alike == 1024:
        assert [tuple(r.values()) for r in got] == want and len(want) < n
    found = {(r["bucket"], r["node"]) for r in got}
    index = {(b, d): k for k, (b, d) in enumerate(zip(bucket.tolist(), node.tolist()))}
    met = [(i, j) for i in index.values() for j in index.values() if i < j and bucket[i] == bucket[j] and own[i] != own[j] and near(i, j)]
    assert met and all((bucket[k], node[k]) in found for pair in met for k in pair)
