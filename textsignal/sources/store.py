"""An append-only store of text vectors, bucketed by the first digits of the text's hash.

The bucket is a partition column, so an update reads only the buckets that its texts fall into, and only those folders get
new files; what is stored is never written again.  One writer at a time; a reader sees whole appends, since Spark commits
a job's files together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textsignal.session import materialize

SCHEMA = "text_hash string, embedding array<float>, bucket string"


class TextStore:
    """Vectors by text hash under ``path``; ``digits`` hexadecimal digits make 16 ** digits buckets (at most 4,096)."""

    def __init__(self, spark: SparkSession, path: str, digits: int = 2):
        if not 1 <= digits <= 3:
            raise ValueError("digits must be 1, 2 or 3")
        self.spark, self.path, self.digits = spark, path, digits

    def read(self) -> DataFrame:
        """(text_hash, embedding, bucket) of everything stored; empty where nothing is."""
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def keyed(self, texts: DataFrame, text_col: str = "text") -> DataFrame:
        """(text_hash, text, bucket): one row per distinct non-null text; only hashes are shuffled before equal ones are dropped."""
        t = texts.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull()).withColumn("text_hash", F.sha2("text", 256))
        t = t.groupBy("text_hash").agg(F.any_value("text").alias("text"))
        return t.withColumn("bucket", F.substring("text_hash", 1, self.digits))

    def missing(self, texts: DataFrame, text_col: str = "text") -> DataFrame:
        """The distinct texts that the store lacks; only the buckets that they fall into are read."""
        t = self.keyed(texts, text_col)
        touched = [r["bucket"] for r in t.select("bucket").distinct().collect()]       # at most 16 ** digits
        stored = self.read().where(F.col("bucket").isin(touched)).select("bucket", "text_hash")
        return t.join(stored, ["bucket", "text_hash"], "left_anti")

    def update(self, texts: DataFrame, embed: Callable[[DataFrame], DataFrame], text_col: str = "text") -> int:
        """Embeds the missing texts and appends their vectors; returns how many.  ``embed`` gets (text_hash, text) and gives
        (text_hash, embedding)."""
        fresh = materialize(self.missing(texts, text_col))
        rows = materialize(embed(fresh.select("text_hash", "text")).select("text_hash", F.col("embedding").cast("array<float>").alias("embedding")))
        n = rows.count()
        if n:
            rows = rows.withColumn("bucket", F.substring("text_hash", 1, self.digits))
            rows.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self.path)
        return n
