"""A cleaning pipeline over ``documents``; each stage reads the Parquet table that the stage before it wrote.

Every stage takes ``(spark, docs, sf_dir)``. All but the last return rows of ``documents`` with its columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from applause.llm import bpe, decontaminate, exact_dedup, language_id, simhash
from applause.session import scratch_path

LEAST_SCORE = 0.5  # below it a text is more likely not in the predicted language


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without a letter, and undecided ones, go."""
    return language_id.recognised(docs, language_id.training_rows(docs), LEAST_SCORE)


def unique_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id."""
    return exact_dedup.drop_duplicates(docs)


def unlike_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id."""
    return simhash.drop_near_duplicates(docs)


def unseen_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, text``: the ids of each document and the text they decode to."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = bpe.encode_and_decode(docs, ranks, pattern)
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("language ID", known_language),
    ("exact dedup", unique_texts),
    ("SimHash near-dedup", unlike_texts),
    ("benchmark decontamination", unseen_benchmark),
    ("byte-level BPE", token_ids),
]

ORACLE_SQL = None  # language models and SimHash components have no SQL form; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = scratch_path(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        out = f"{path}/{number}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
