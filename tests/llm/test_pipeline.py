"""Each stage of the pipeline against a plain version, with repeated and null ids, equal rows and empty tables."""

import random
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from cartolode.llm import shingles
from cartolode.llm.decontaminate import Matcher
from cartolode.llm.secrets import scan
from tests.llm.test_operators import WORDS, word_list

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(texts):
    return [(d, t, lang, source, None if t is None else len(t)) for d, t, lang, source in texts]


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(11)
    text = lambda lang, n: " ".join(rnd.choice(WORDS[lang]) + rnd.choice(["", "s", "er", "en", "t"]) for _ in range(n))
    rows = [(k, text("en" if k % 3 else "de", rnd.randint(20, 90)), "en" if k % 3 else "de", f"src{k % 4}") for k in range(240)]
    near = rows[7][1].split()
    near[3] = "altered"
    long = text("en", 300).split()
    other = [*long[:150], "altered", *long[151:]]
    rows += [(300, " ".join(long), "en", "src1"), (301, " ".join(other), "en", "src2"), (None, " ".join(other), "en", "src2")]
    rows += [rows[5], rows[5], (5, text("en", 40), "en", "src0"), (310, rows[10][1].upper(), "en", "src3"), (None, rows[10][1], "en", "src3")]
    rows += [(320, None, "en", "src0"), (321, "", None, None), (322, "12 34", "en", "src0"), (None, None, None, None), (None, None, None, None)]
    rows += [(330, f"{text('en', 20)} token = \"a9f8e7d6c5b4a392\" {text('en', 20)}", "en", "src1")]
    return rows_of(rows)


def collected(df):
    return Counter(tuple(r) for r in df.collect())


def test_language_stage(spark, corpus):
    odd = [(900 + k, "ж" * 30 + " щы" * 40, None, "src0", 150) for k in range(3)] + [(5, "1 2 3", None, "src0", 5)]
    df = spark.createDataFrame(corpus + odd, COLUMNS)
    kept = collected(pipeline.language_id(spark, df, ""))
    letters = Counter(r for r in corpus if any(c.isalpha() for c in r[1] or ""))
    assert kept == letters


def test_dedup_stage(spark, corpus):
    kept = collected(pipeline.simhash_dedup(spark, spark.createDataFrame(corpus, COLUMNS), ""))
    sets = [frozenset(shingles.shingle_set((r[1] or "").encode().lower().split()).tolist()) for r in corpus]
    group = list(range(len(corpus)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    stays = {}
    for g, r in zip(group, corpus):
        stays[g] = min(stays.get(g, r), r, key=lambda x: (x[0] is None, x[0] or 0))
    assert all(n == 1 for n in kept.values()) and sum(kept.values()) == len(stays)
    assert Counter(r[0] for r in kept) == Counter(r[0] for r in stays.values())
    assert Counter(r[0] for r in kept)[5] == 2 and {301, 310, 321} & {r[0] for r in kept} == set()


def test_decontamination_stage(spark, corpus, tmp_path):
    items = [(1, corpus[20][1][:120]), (2, "no such passage stands in any of these texts"), (3, corpus[-1][1])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    more = [*corpus, (5, f"x {items[0][1]} y", "en", "src0", 9), (None, items[0][1], None, None, 9)]
    matcher = Matcher(items, 8, 0.1)
    want = Counter(r for r in more if not matcher.search(r[1]))
    assert collected(pipeline.decontaminate(spark, spark.createDataFrame(more, COLUMNS), str(tmp_path))) == want
    assert len(more) - sum(want.values()) >= 4


def test_redaction_stage(spark, corpus):
    got = collected(pipeline.redact(spark, spark.createDataFrame(corpus, COLUMNS), ""))
    want = Counter()
    for d, t, lang, source, n in corpus:
        base, added = scan(t)
        clean = t if not base else t.replace("a9f8e7d6c5b4a392", "<secret>")
        assert not added and (not base or clean != t)
        want[d, clean, lang, source, n if t is None else len(clean)] += 1
    assert got == want


def test_mixing_stage(spark, corpus):
    got = pipeline.mix(spark, spark.createDataFrame(corpus, COLUMNS), "").collect()
    sizes = Counter()
    for _, t, _, source, _ in corpus:
        sizes[source] += len(word_list(t))
    taken = Counter()
    for r in got:
        assert r["copies"] > 0 and r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    targets = {r["source"]: r["target"] for r in got}
    assert sum(targets.values()) == pytest.approx(sum(sizes.values())) and all(abs(taken[s] - targets[s]) <= 300 for s in targets)


def test_stages_take_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], COLUMNS)
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_run_carries_decisions_through(spark, corpus, tmp_path):
    spark.createDataFrame(corpus, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, corpus[20][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    ids = [r["doc_id"] for r in pipeline.run(spark, str(tmp_path)).collect()]
    assert not {20, 301, 310, 320, 321, 322} & set(ids) and None not in ids and len(ids) > 100
