"""The corpus pipeline: raw documents to token ids, one operator a stage.

Every stage reads what its predecessor kept, is written as Parquet in the
shared folder and read again. All but the last return the columns of the
documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from querygrove.llm import byte_bpe, decontaminate, minhash, quality_rules, suffix_dedup
from querygrove.llm.scratch import text_batches, written

#: Texts in an Arrow batch: executors that run all stages hold less at once than those of a single operator.
BATCH_ROWS = 128

#: No stage but the first is expressible in SQL; the tests compare run() with a brute-force version.
ORACLE_SQL: str | None = None


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    text_batches(spark, BATCH_ROWS)
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates."""
    return minhash.keep_first(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of repeated long strings."""
    return suffix_dedup.drop_repeats(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of each text, their number, and the digests of ids and decoded bytes."""
    vocabulary = byte_bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return byte_bpe.digests(byte_bpe.encode(docs, vocabulary, decoded="decoded"), ["doc_id", "ids"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", rules), ("minhash_near_dedup", near_duplicates), ("suffix_array_dedup", repeats),
    ("benchmark_decontamination", leaks), ("byte_level_bpe", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
