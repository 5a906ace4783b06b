"""URL filter: host and path rules, and gradient-boosted trees over lexical features for the URLs that no rule fits."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, save, small, table

#: The contract's rules.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Where the caller has no labelled URLs, those whose host holds one of these words are labelled as blocked and all others as
#: allowed. The features do not hold the words, so the trees learn what such hosts look like, not the list.
BLOCK_WORDS = ("spam", "pills", "casino", "porn", "viagra", "xxx", "bets", "malware", "phish")
#: At most about so many different labelled URLs of each label are learned from.
TRAIN_URLS = 10_000
#: Hosts are dealt into folds; what a suffix says of a URL is counted in the other folds only.
FOLDS = 5


def parse_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty where url is null or has no `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host, path = (F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", k), F.lit("")) for k in (1, 2))
    return lower_ascii(host), path


def match_rules(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the URL's or a parent of it and whose path begins the URL's."""
    longest = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    fits = []
    for verdict, rule in longest:
        name, slash, rest = rule.partition("/")
        inside = (host == name) | host.endswith("." + name)
        fits.append((inside & path.startswith(slash + rest), rule, verdict))
    pick = lambda k: reduce(lambda rest, f: F.when(f[0], f[k]).otherwise(rest), reversed(fits), F.lit(None).cast("string"))
    return pick(1), pick(2)


def _entropy(text: Column) -> Column:
    """Bits per character, from the counts of each letter, digit and sign."""
    n = F.greatest(F.length(text), F.lit(1))
    alphabet = "abcdefghijklmnopqrstuvwxyz0123456789-._"
    parts = [F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in alphabet]
    return reduce(lambda a, b: a + b, [F.when(p > 0, -(p / n) * F.log2(p / n)).otherwise(0.0) for p in parts])


def fold_of(host: Column) -> Column:
    return F.pmod(F.xxhash64(host, F.lit(5)), F.lit(FOLDS))


def features(urls: DataFrame) -> DataFrame:
    """urls(url, host, path) with lexical feature columns f_*; empty URLs have zeros."""
    host, path, url = F.col("host"), F.col("path"), F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    made = {
        "length": F.length(url), "host_length": F.length(host), "path_length": F.length(path),
        "depth": count(path, "/[^/]"), "labels": count(host, r"[^.]+"), "hyphens": count(host, "-"),
        "digits": count(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)), "host_digits": count(host, "[0-9]"),
        "entropy": _entropy(host), "parameters": count(query, "[^&]+"), "escapes": count(url, "%[0-9A-Fa-f]{2}"),
        "longest_label": F.coalesce(F.array_max(F.transform(F.split(host, r"\."), F.length)), F.lit(0)),
        "secure": url.startswith("https://").cast("double"),
    }
    return urls.withColumns({f"f_{k}": v.cast("double") for k, v in made.items()}).withColumns({"suffix": F.regexp_extract(host, r"[^.]*$", 0), "fold": fold_of(host)})


def host_labels(urls: DataFrame, block_words=BLOCK_WORDS) -> DataFrame:
    """Labels (url, label 0/1) by words in the host; URLs without host have none."""
    host = parse_url(F.col("url"))[0]
    named = reduce(lambda a, b: a | b, [F.contains(host, F.lit(w)) for w in block_words])
    return urls.where(host != "").select("url", named.cast("int").alias("label"))


def draw(labelled: DataFrame, train_urls: int = TRAIN_URLS) -> DataFrame | None:
    """Features, fold, label and weight of about train_urls different URLs of each label of labelled(url, label 0/1), drawn by
    hash; None unless both labels occur. Null labels and URLs teach nothing; a URL with both labels counts with both."""
    labelled = labelled.where("label in (0, 1) and url is not null").select("url", F.col("label").cast("double").alias("label"))
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.approx_count_distinct("url").alias("n")).collect()}
    if len(counts) < 2:
        return None
    share = F.when(F.col("label") == 1, train_urls / counts[1]).otherwise(train_urls / counts[0])
    host, path = parse_url(F.col("url"))
    drawn = labelled.where(F.pmod(F.xxhash64("url", F.lit(8)), F.lit(1_000_000)) / 1e6 < share).distinct()
    drawn = save(features(drawn.withColumns({"host": host, "path": path})), "labelled")
    mean = drawn.agg(F.avg("label")).first()[0]
    if mean in (None, 0.0, 1.0):
        return None
    return drawn.withColumn("weight", F.when(F.col("label") == 1, 0.5 / mean).otherwise(0.5 / (1 - mean)))


def suffix_shares(drawn: DataFrame) -> DataFrame:
    """(suffix, fold, f_suffix): the smoothed share of blocked URLs of the suffix among the drawn ones of all other folds;
    suffixes of few URLs stay near the whole. A suffix that occurs has a row for every fold."""
    mean = drawn.agg(F.avg("label")).first()[0]
    by = drawn.groupBy("suffix", "fold").agg(F.sum("label").alias("up"), F.count("*").alias("n"))
    all_ = by.groupBy("suffix").agg(F.sum("up").alias("all_up"), F.sum("n").alias("all_n"))
    folds = all_.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(FOLDS - 1).cast("long"))).alias("fold")).join(by, ["suffix", "fold"], "left").fillna(0, ["up", "n"])
    return save(folds.select("suffix", "fold", ((F.col("all_up") - F.col("up") + 20 * mean) / (F.col("all_n") - F.col("n") + 20)).alias("f_suffix")), "suffixes")


def fit_trees(drawn: DataFrame):
    """(fitted trees, suffix shares, share of blocked URLs) from draw's rows."""
    suffixes, mean = suffix_shares(drawn), drawn.agg(F.avg("label")).first()[0]
    trees = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=15, maxDepth=4, maxBins=32, seed=7, cacheNodeIds=False)
    return trees.fit(_vectors(drawn, suffixes, mean)), suffixes, mean


def held_out_auc(labelled: DataFrame, train_urls: int = TRAIN_URLS) -> float | None:
    """Area under the ROC curve on the URLs of the hosts of one fold, the first that has both labels, by trees that saw only
    hosts of the others; None where there is none."""
    drawn = draw(labelled, train_urls)
    if drawn is None:
        return None
    seen = drawn.groupBy("fold").agg(F.sum("label").alias("up"), F.sum(1 - F.col("label")).alias("down")).orderBy("fold").collect()
    for r in seen:
        if r["up"] and r["down"] and all(sum(x[c] for x in seen) > r[c] for c in ("up", "down")):
            trees, suffixes, mean = fit_trees(drawn.where(F.col("fold") != r["fold"]))
            judged = trees.transform(_vectors(drawn.where(F.col("fold") == r["fold"]), suffixes, mean))
            return BinaryClassificationEvaluator(labelCol="label").evaluate(judged)
    return None


def _vectors(rows: DataFrame, suffixes: DataFrame, mean: float) -> DataFrame:
    names = [c for c in rows.columns if c.startswith("f_")] + ["f_suffix"]
    joined = rows.join(small(suffixes), ["suffix", "fold"], "left").fillna({"f_suffix": mean})
    return VectorAssembler(inputCols=names, outputCol="features").transform(joined)


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, labelled: DataFrame | None = None, train_urls: int = TRAIN_URLS) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) per row of pages.

    Rules decide first. Other URLs get the trees' verdict: blocked where their probability of it is over one half. The
    trees learn from labelled(url, label: 1 for blocked), a bounded sample of it by hash; without it from the pages' own URLs
    with host_labels. Where only one label occurs the other URLs are allowed. score is null where a rule decides.

    Null URLs and those without `://` have empty host and path, fit no rule and are allowed; rows that repeat are judged
    alike; ids may be null; other columns are ignored; an empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    host, path = parse_url(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path})
    rule, decided = match_rules(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "decided": decided})
    drawn = draw(host_labels(rows) if labelled is None else labelled, train_urls)
    if drawn is None:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("decided", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    trees, suffixes, mean = fit_trees(drawn)
    judged = trees.transform(_vectors(features(rows), suffixes, mean))
    score = vector_to_array("probability")[1]
    guess = F.when((score > 0.5) & (F.col("host") != ""), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("decided", guess).alias("verdict"), F.when(F.col("decided").isNull(), score).alias("score"))


def op8_url_gbt(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
