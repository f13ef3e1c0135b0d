"""A corpus pipeline: quality rules, near-dedup, substring dedup, mixing, packing.

Each stage is a function of (spark, docs, sf_dir) that works on all rows the stage before it
kept.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import mixing, near, pack, quality, queries, store, substring


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the log-likelihood ratio reject go."""
    judged = quality.score_quality(docs, queries.table(spark, sf_dir, "labels"))
    return judged.where("rules.kept").drop("rules")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that with the smallest id."""
    return near.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """13-word windows that also start in a document with a smaller id are removed; n_chars follows."""
    return substring.remove_repeats(docs, whole_rows=True).withColumn("n_chars", F.length("text").cast("long"))


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rates say (repeated rows are epochs)."""
    made = mixing.mix(docs, queries.table(spark, sf_dir, "labels"))
    times = F.explode_outer(F.sequence(F.lit(1), F.col("copies"), F.lit(1)))
    return made.where("copies > 0").select("_doc", times).select("_doc.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 2048 tokens."""
    return pack.pack_documents(docs, queries.tokenizer())


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing", mixing_weights),
    ("best-fit packing", best_fit_packing),
]

#: SQL has none of the hashes and fits that the stages use; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read by the next."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
