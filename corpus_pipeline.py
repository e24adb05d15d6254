"""A training-corpus pipeline of five of the llm operators; each stage rewrites the documents for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common, dedup, mixing, ngram_join, packing, toxicity


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold, by a model learnt from the table of labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, held_out=toxicity.held_out)
    return toxicity.score(docs, model, column="__score").where(F.col("__score") < toxicity.THRESHOLD).drop("__score")


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one that op4's rule keeps."""
    return dedup.deduplicate(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the one with the least doc_id."""
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once, or more."""
    return mixing.apply(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces, as op3 gives them."""
    return packing.digest(packing.pack(docs))


STAGES = [
    ("toxicity", remove_toxic),
    ("exact_dedup", remove_copies),
    ("ngram_jaccard_join", remove_near_copies),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL cannot express the trained classifier or the packing; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
