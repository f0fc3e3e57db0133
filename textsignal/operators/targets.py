"""Direction targets (W1, W2) and the previous-direction feature.

Horizons count *rows* (trading days) by default (T18); ``calendar=True`` uses
``date + h`` instead.  A row without a future price gets no target (T4): it is
dropped, never labelled 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textsignal.functions.columns import finite_or_null


def _future(df: DataFrame, h: int, price: str, asset: str, date: str, calendar: bool):
    if not calendar:
        w = Window.partitionBy(asset).orderBy(date)
        return df.select("*", F.lead(price, h).over(w).alias(f"_future_{h}"))
    fut = df.select(F.col(asset).alias("_a"), F.date_sub(date, h).alias("_d"),
                    F.col(price).alias(f"_future_{h}"))
    return df.join(fut, (df[asset] == fut["_a"]) & (df[date] == fut["_d"]), "left").drop("_a", "_d")


def direction_target(bars: DataFrame, horizon: int = 1, price: str = "close", asset: str = "asset",
                     date: str = "date", calendar: bool = False, name: str = "y") -> DataFrame:
    """W1 + P8: y = 1{price[t+h] > price[t]}.  Rows without an asset, a date or a price aren't trading days: they take
    no part, so horizons count the others; rows without price[t+h] are dropped."""
    priced = bars.where(F.col(asset).isNotNull() & F.col(date).isNotNull() & F.col(price).isNotNull())
    df = _future(priced, horizon, price, asset, date, calendar)
    fut = F.col(f"_future_{horizon}")
    return (df.where(fut.isNotNull())
            .withColumn(name, (fut > F.col(price)).cast("int"))
            .drop(f"_future_{horizon}"))


def multi_horizon_target(bars: DataFrame, horizons: Sequence[int] = (1, 3, 7), price: str = "close",
                         asset: str = "asset", date: str = "date", keep: Sequence[str] = ()) -> DataFrame:
    """W2 + P8: long form (asset, date, price, keep, horizon, future_close, y), all leads in one window; rows without a
    key or a price take no part."""
    w = Window.partitionBy(asset).orderBy(date)
    priced = bars.where(F.col(asset).isNotNull() & F.col(date).isNotNull() & F.col(price).isNotNull())
    wide = priced.select(asset, date, price, *keep, *[F.lead(price, h).over(w).alias(f"f{h}") for h in horizons])
    stack = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"f{h}").alias("future_close"))
                                for h in horizons])).alias("s")
    return (wide.select(asset, date, price, *keep, stack)
            .select(asset, date, price, *keep, "s.horizon", "s.future_close")
            .where(F.col("future_close").isNotNull())
            .withColumn("y", (F.col("future_close") > F.col(price)).cast("int")))


def previous_direction(df: DataFrame, horizon: int = 1, y: str = "y", asset: str = "asset",
                       date: str = "date", lag_rows: int | None = None) -> DataFrame:
    """The label known at t.  Default lag = horizon (T10: lag 1 leaks for h>1)."""
    lag_rows = horizon if lag_rows is None else lag_rows
    w = Window.partitionBy(asset).orderBy(date)
    return df.withColumn("previous_direction", F.lag(y, lag_rows).over(w))


def coerce_dates(df: DataFrame, date: str) -> DataFrame:
    """Lenient dates; rows whose date can't be read are dropped."""
    return df.withColumn(date, F.try_to_timestamp(F.col(date).cast("string")).cast("date")).where(F.col(date).isNotNull())


def ensure_target(df: DataFrame, y: str) -> DataFrame:
    """Rows with a valid (finite) target, as an integer."""
    return df.withColumn(y, finite_or_null(F.col(y).try_cast("double"))).where(F.col(y).isNotNull()).withColumn(
        y, F.col(y).cast("int"))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in a total order over ``order`` and then all columns.  A ``min_by``
    over structs is a partial aggregate, so a hot key is reduced in every task."""
    rest = [c for c in df.columns if c not in keys]
    total = [*order, *[c for c in rest if c not in order]]
    g = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*total)).alias("_first"))
    return g.select(*keys, *[F.col("_first")[c].alias(c) for c in rest])
