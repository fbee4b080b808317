"""A training-data pipeline over documents: each stage reads what the one before has kept.

Stages: documents that the quality classifier rejects go; lines of recurring templates go; one document of each group
of near copies stays (five-word shingles, a Jaccard similarity of 0.8); benchmark passages are cut out, and documents
that consist mostly of them go; what is left is packed into sequences of at most 4096 tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracelode.llm import decontamination, jaccard_join, line_dedup, packing, quality
from tracelode.llm.common import documents, slim, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    slim(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, quality.trained(docs, labels))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    slim(spark)
    return line_dedup.deduplicated(docs, least=1)


def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    slim(spark)
    return jaccard_join.one_of_each(docs, n=5, percent=80)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    slim(spark)
    return decontamination.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    slim(spark)
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", join_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("best_fit_packing", packing_stage),
]

#: A classifier, templates and components aren't SQL: see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; the others are written below the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
