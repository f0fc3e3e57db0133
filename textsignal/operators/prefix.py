"""Two-level prefix sums: running sums and row numbers inside a key whose rows don't fit one task.

The rows are dealt to ranges of (key, order) by Spark's sampled splitters; a range is a bounded part of a key.  Each
range's sum per key is a row of a small table, whose running sum gives what lies before the range; only inside a range
does a window run.  The ranges are written (checkpoint) before they are numbered, so a task that runs again finds the
same ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textsignal.session import materialize


def running_before(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column | None = None, name: str = "before",
                   ranges: int | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` (or the number of rows) of the rows before this one in ``order`` inside
    its key.  Rows equal in ``order`` are taken in any one order, so ``order`` should be total.  ``ranges`` defaults to the session's
    shuffle width, joined by size where the session adapts."""
    keys = [*by, *order]
    dealt = df.repartitionByRange(ranges, *keys) if ranges else df.repartitionByRange(*keys)
    one = F.lit(1) if value is None else value
    dealt = materialize(dealt.withColumn("_range", F.spark_partition_id()).withColumn("_value", F.coalesce(one.cast("long"), F.lit(0))))
    sums = dealt.groupBy(*by, "_range").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_range").alias("_r"),
                       F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("_local", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return local.join(sums, same).select(*df.columns, (F.col("_offset") + F.col("_local")).alias(name))
