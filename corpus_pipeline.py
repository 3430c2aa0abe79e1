"""A corpus pipeline of five stages over `documents`. Each stage takes what its predecessor kept, whole.

1. Quality rules: documents that fail them, or that host-wide boilerplate lines leave depleted, go; the lines go from the rest.
2. Near duplicates (sets of 5-word shingles, similarity 0.8 or more): the smallest doc_id of each group stays.
3. Repeated runs of 35 words or more are cut out of the texts.
4. Passages of the benchmark are cut out; documents that are mostly benchmark go.
5. Texts are encoded to token ids and decoded again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagelode import reach_workers
from pagelode.llm import bpe, decontam, near_dedup, quality, recompress
from pagelode.llm.common import clear, forget, mark, work_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    reach_workers(spark)
    return quality.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    reach_workers(spark)
    return near_dedup.deduplicated(docs, words=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    reach_workers(spark)
    return recompress.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    reach_workers(spark)
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    reach_workers(spark)
    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: SQL can't express the merges of the last stage; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written; what a stage has written on its way goes with the rows it was given."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = work_path(spark, name)
        since = mark()
        stage(spark, docs, sf_dir).write.parquet(path)
        clear(spark, since)
        if before:
            forget(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
