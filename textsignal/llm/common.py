"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from textsignal.session import ensure_checkpoint_dir
from textsignal.sources.tables import load

#: A word is a maximal run of characters outside the space and tab..carriage return (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of whole texts that a Python function gets at once where ``stash`` says so.
TEXTS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents")


@contextmanager
def _batches(spark: SparkSession, rows: int | None):
    """Plans made here hand at most ``rows`` rows at once to Python functions (None: as the session has it)."""
    old = spark.conf.get(_BATCH)
    if rows is not None and not 0 < int(old) <= rows:      # a smaller width of the session stays
        spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, old)


def stash(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write an intermediate table once into the shared checkpoint folder and read it back: the
    lineage is cut, several consumers share one computation, and a lost executor loses nothing.
    ``rows`` bounds the batches of its Python functions, so that workers and executors hold few whole texts."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with _batches(spark, rows):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def buckets(df: DataFrame, least: int = 8) -> int:
    """A number of hash buckets that follows the session's shuffle width."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
