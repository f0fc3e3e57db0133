"""The training-data pipeline: ``STAGES`` over ``documents``; each stage's rows are written as Parquet
and reread as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textsignal.llm import op1_mixing, op6_jaccard_join, op7_sentencepiece, op8_quality, op10_secrets
from textsignal.llm.common import documents, stash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the rules reject go."""
    return op8_quality.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: one document of each component stays."""
    return op6_jaccard_join.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: secrets are masked in the texts; every document stays."""
    return op10_secrets.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the kept documents replicated and shuffled to tempered source weights."""
    return op1_mixing.mix(docs).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: the pieces of every remaining text."""
    return op7_sentencepiece.encode(docs)


STAGES = [("quality rules", quality), ("n-gram jaccard join", near_duplicates), ("secret scans", secrets),
          ("mixing sources", mixing), ("sentencepiece", encoding)]

#: Later stages use a trained forest and a piece automaton, which SQL can't express; tests compare a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs, f"pipeline-{i}")
    return docs
