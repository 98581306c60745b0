"""A training corpus from raw documents: five stages, each over all that the one before kept.

Toxic documents go, one of each group of near-duplicates stays, passages that occur elsewhere are cut, documents with
benchmark passages go, and the rest is encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsewake.llm.bpe import encode_texts
from pulsewake.llm.components import written
from pulsewake.llm.decontaminate import remove_contaminated
from pulsewake.llm.near import drop_near_duplicates
from pulsewake.llm.repeats import remove_repeats
from pulsewake.llm.toxicity import drop_toxic
from pulsewake.runtime import reach_workers


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic."""
    reach_workers(spark)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates."""
    reach_workers(spark)
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that occur at another place as well."""
    reach_workers(spark)
    return remove_repeats(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    reach_workers(spark)
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of ids and decoded bytes."""
    reach_workers(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_texts(docs, path, public_tokenizers.PATTERN).drop("text")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: The stages before the last have no SQL of their own result: toxicity is learned.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
