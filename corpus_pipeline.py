"""A training corpus from ``documents``: identify languages, drop exact and near
copies, drop benchmark leaks, pack into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again for the next one.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shipgraph.llm import decontam, dedup, jaccard, langid, packing
from shipgraph.llm.common import documents, work_dir
from shipgraph.llm.registry import tokenizer


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without an identifiable language (null, or no letter)."""
    return langid.drop_unidentified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return dedup.drop_duplicates(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest doc_id stays."""
    return jaccard.drop_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontam.decontaminate(docs, benchmark, remove="documents")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences of 1024 tokens."""
    return packing.packed_documents(docs, tokenizer("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup),
          ("jaccard_join", jaccard_join), ("decontamination", decontamination),
          ("best_fit_packing", best_fit_packing)]

#: Language models, components and the tokenizer aren't SQL; tests hold the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = work_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
