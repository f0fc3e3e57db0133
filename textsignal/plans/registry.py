"""Query registry: ``name -> (spark_fn(spark, sf_dir) -> DataFrame, oracle SQL | None)``.

Spark results round every floating column to 6 decimals; the SQL twins apply
the same ``R()`` rounding so both sides hash identically.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textsignal.functions.columns import round_doubles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6


def R(expr: str, digits: int = DIGITS) -> str:
    """SQL rounding twin of ``round_doubles`` (the ``+ 0.0`` folds -0.0 into 0.0)."""
    return f"(round(CAST({expr} AS DOUBLE) * {float(10 ** digits)!r}) / {float(10 ** digits)!r} + 0.0)"


def register(name: str, sql: str | None = None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir), DIGITS)
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco
