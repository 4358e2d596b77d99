"""Queries of the training-data operators, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (bpe_codec, bpe_count, conversations, decontam, dedup, html_extract, huffman,
               jaccard, langid, packing, secrets, substring, whitening)
from .common import documents


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file on this machine and the executors'."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(documents(spark, sf_dir, "doc_id", "text"),
                                    tokenizer("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_duplicates(documents(spark, sf_dir))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(documents(spark, sf_dir, "doc_id", "text"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(documents(spark, sf_dir, "doc_id", "text", "lang"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(documents(spark, sf_dir))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.round_trip(documents(spark, sf_dir, "doc_id", "text"),
                              tokenizer("byte_bpe_50k.json"), end_id=0)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontam.report(documents(spark, sf_dir), benchmark)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.token_counts(documents(spark, sf_dir, "doc_id", "text"),
                                  tokenizer("piece_bpe_32k.model"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.without_repeats(documents(spark, sf_dir))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet")
    return html_extract.extracted(pages.select("page_id", "url", "html"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    return whitening.whitened(vectors.select("vec_id", "embedding"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return bpe_codec.round_trip(documents(spark, sf_dir, "doc_id", "text"),
                                tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired_after_damage(
        spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet"))


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_exact_dedup, op3_secret_scan, op4_language_id, op5_jaccard_join,
    op6_token_files, op7_decontamination, op8_token_counts, op9_substring_dedup,
    op10_html_extraction, op11_embedding_whitening, op12_byte_bpe, op13_conversation_repair)}

ORACLE = {"op2_exact_dedup": dedup.ORACLE, "op7_decontamination": decontam.ORACLE,
          "op9_substring_dedup": substring.ORACLE}
