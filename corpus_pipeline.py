"""A training-corpus pipeline: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolode.llm.common import remainder, save, small, table, text_batches
from cartolode.llm.decontaminate import find_leaks
from cartolode.llm.langid import identify, train
from cartolode.llm.mixing import mix_sources
from cartolode.llm.secrets import redact_secrets
from cartolode.llm.shingles import similar_groups


KEY = "_row_key"


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of each row: the hash of all its columns, so that decisions fall on rows and not on ids, which may
    repeat or be null. Rows that are equal in all columns share a key and every decision but that of which copy stays."""
    return docs.withColumn(KEY, F.xxhash64(*docs.columns))


def _without(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose key is not among those of gone(doc_id), without the key."""
    with text_batches(keyed.sparkSession):
        keys = small(save(gone.select(F.col("doc_id").alias(KEY)).distinct(), "gone"))
    return keyed.join(keys, KEY, "left_anti").drop(KEY)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that language identification rejects: no letters, or unlike every language learned."""
    model = train(docs.where(remainder(F.col("doc_id"), 4) != 2))
    keyed = _keyed(docs)
    return _without(keyed, identify(keyed, model, id_col=KEY).where("rejected"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by five-word shingles of similarity 0.8 or more: the one with the smallest
    doc_id, null ids last, and of those that share it the one with the smallest key; of equal rows one."""
    keyed = _keyed(docs)
    groups = similar_groups(keyed, id_col=KEY).withColumnRenamed("doc_id", KEY).distinct()
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", KEY)
    named = save(keyed.select(KEY, "doc_id").join(groups, KEY).select("component_id", KEY, "doc_id").distinct(), "grouped")
    stays = save(named.groupBy("component_id").agg(F.min(first).alias("x"), F.count("*").alias("n")), "stays")
    gone = named.join(stays.where("n > 1").select("component_id", F.col(f"x.{KEY}").alias("kept")), "component_id").where(F.col(KEY) != F.col("kept"))
    copies = small(save(keyed.groupBy(KEY).count().where("count > 1").select(KEY), "copies"))
    equal, single = keyed.join(copies, KEY, "left_semi").dropDuplicates([KEY]), keyed.join(copies, KEY, "left_anti")
    return _without(single.unionByName(equal), gone.select(F.col(KEY).alias("doc_id")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark passage."""
    keyed = _keyed(docs)
    return _without(keyed, find_leaks(keyed, table(spark, sf_dir, "benchmark"), id_col=KEY))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace the secrets in each text by a mark and keep all documents; n_chars follows the text."""
    clean = redact_secrets(docs)
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind))).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how many times and words: (doc_id, source, size, target, copies, taken)."""
    return mix_sources(docs).where("copies > 0").select("doc_id", "source", "size", "target", "copies", "taken")


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("decontaminate", decontaminate),
    ("secret_scan", redact),
    ("mix_sources", mix),
]
#: The stages learn models and align texts, which SQL cannot express; tests/llm/test_pipeline.py holds each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = save(docs, name)
    return docs
