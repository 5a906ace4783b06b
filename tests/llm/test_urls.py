"""The trees on hosts that they have not seen, and labels that the caller gives."""

import random

from cartolode.llm import urls


def labelled(spark, n=400, seed=2):
    """Blocked hosts are long, with hyphens and digits; each URL has a host of its own."""
    rnd, rows = random.Random(seed), []
    word = lambda k: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    for k in range(n):
        bad = k % 2
        host = f"{word(5)}-{word(6)}-{rnd.randint(10, 999)}.info" if bad and k % 4 == 1 else f"{word(4)}{rnd.randint(100, 99999)}-{word(5)}.com" if bad else f"{word(rnd.randint(4, 9))}.{rnd.choice(['com', 'org'])}"
        rows.append((f"https://{host}/{word(4)}/{rnd.randint(1, 99)}?a={k}", bad))
    return spark.createDataFrame(rows + rows[:30] * 3 + [(None, 1), ("https://x.y/", None)], "url string, label int")


def test_unseen_hosts_are_told_apart(spark):
    assert urls.held_out_auc(labelled(spark)) > 0.9
    shuffled = labelled(spark).selectExpr("url", "abs(hash(url)) % 2 as label")
    assert 0.2 < urls.held_out_auc(shuffled) < 0.8
    assert urls.held_out_auc(labelled(spark).where("label = 1")) is None


def test_labels_are_the_callers(spark):
    pages = labelled(spark, 60, seed=9).where("label is not null").selectExpr("row_number() over (order by url) as page_id", "url", "label as truth", "1 as label", "2 as fold")
    got = urls.filter_urls(pages, rules=(), labelled=labelled(spark)).join(pages.select("page_id", "truth"), "page_id").where("host <> ''").collect()
    right = [(r["verdict"] == "block") == bool(r["truth"]) for r in got]
    assert sum(right) / len(right) > 0.85 and {r["rule"] for r in got} == {None}


def test_suffix_shares_leave_out_the_own_fold(spark):
    rows = [(f"https://h{k}.top/", 1) for k in range(200)] + [(f"https://h{k}.com/", 0) for k in range(200)]
    drawn = urls.draw(spark.createDataFrame(rows, "url string, label int"))
    shares = {(r["suffix"], r["fold"]): r["f_suffix"] for r in urls.suffix_shares(drawn).collect()}
    counts = {(r["suffix"], r["fold"]): r["count"] for r in drawn.groupBy("suffix", "fold").count().collect()}
    assert len(shares) == 10
    for (suffix, fold), share in shares.items():
        others = sum(n for (s, f), n in counts.items() if s == suffix and f != fold)
        assert abs(share - ((others if suffix == "top" else 0) + 10) / (others + 20)) < 1e-9
