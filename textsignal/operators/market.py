"""Market side: daily bars from ticks (A20) and window features.

Every window is ``partitionBy(asset).orderBy(date)`` over *daily* rows, so the
whole feature set costs one exchange on ``asset`` plus one sort; the rows per
task are the trading days of one asset (thousands), never ticks.  Rolling
statistics are gated to full windows (T3) so they equal pandas ``rolling(k)``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textsignal.functions.schema import normalize_name
from textsignal.functions.columns import col_, log_ratio, safe_div, safe_ln

RETURN_KS = (2, 5, 10)
VOLUME_KS = (5, 10, 20)
INC_KS = (5, 10, 15, 20, 25, 30)


def daily_bars(ticks: DataFrame, asset: str | Column, ts: str | Column, price: str | Column,
               volume: str | Column | None = None, order: Column | None = None) -> DataFrame:
    """OHLCV per (asset, day).  open/close are the first/last price by ``order`` (default ts).

    Pure hash aggregate with map-side partial aggregation: each task pre-reduces
    its ticks, so a hot asset costs one partial row per (task, day).
    """
    order = order if order is not None else col_(ts)
    vol = F.count(F.lit(1)) if volume is None else F.sum(col_(volume))
    bars = (ticks
            .select(col_(asset).alias("asset"), F.to_date(col_(ts)).alias("date"),
                    col_(price).cast("double").alias("price"), order.alias("_ord"),
                    (F.lit(1) if volume is None else col_(volume)).alias("_vol"))
            .groupBy("asset", "date")
            .agg(F.min_by("price", "_ord").alias("open"), F.max("price").alias("high"),
                 F.min("price").alias("low"), F.max_by("price", "_ord").alias("close"),
                 (F.count(F.lit(1)) if volume is None else F.sum("_vol")).alias("volume")))
    return bars.withColumn("adj_close", F.col("close")).select(
        "asset", "date", "open", "high", "low", "close", "adj_close", "volume")


def asset_window(asset: str = "asset", date: str = "date"):
    return Window.partitionBy(asset).orderBy(date)


def _rolling(w, k: int):
    return w.rowsBetween(-(k - 1), 0)


def gated(agg_fn, x: Column, w, k: int) -> Column:
    """Rolling aggregate that is NULL unless the frame holds k non-NULL values."""
    fw = _rolling(w, k)
    return F.when(F.count(x).over(fw) == k, agg_fn(x).over(fw))


def add_increments(bars: DataFrame, ks: Sequence[int] = INC_KS, close: str = "close",
                   asset: str = "asset", date: str = "date") -> DataFrame:
    """inc_k = close / lag(close, k) - 1."""
    w = asset_window(asset, date)
    return bars.select("*", *[(safe_div(close, F.lag(close, k).over(w)) - 1).alias(f"inc_{k}") for k in ks])


def returns_rolling_columns(ks: Sequence[int] = RETURN_KS) -> list[str]:
    cols = ["log_return_1"]
    for k in ks:
        cols += [f"log_return_{k}", f"rolling_mean_return_{k}", f"rolling_vol_{k}", f"ma_{k}", f"resid_ma_{k}"]
    return cols + ["close_to_open_return", "high_low_range", "gap_return"]


def volume_rolling_columns(ks: Sequence[int] = VOLUME_KS) -> list[str]:
    cols = ["log_volume"]
    for k in ks:
        cols += [f"volume_ma_{k}", f"rel_volume_{k}", f"volume_z_{k}"]
    return cols


def add_returns_rolling(bars: DataFrame, ks: Sequence[int] = RETURN_KS, asset: str = "asset",
                        date: str = "date") -> DataFrame:
    """Log returns, rolling mean/vol of returns, MA and residual, intraday ratios."""
    w = asset_window(asset, date)
    c, o, h, lo = F.col("close"), F.col("open"), F.col("high"), F.col("low")
    base = bars.withColumn("log_return_1", log_ratio(c, F.lag(c, 1).over(w)))
    r1 = F.col("log_return_1")
    exprs = []
    for k in ks:
        ma = gated(F.avg, c, w, k)
        exprs += [log_ratio(c, F.lag(c, k).over(w)).alias(f"log_return_{k}"),
                  gated(F.avg, r1, w, k).alias(f"rolling_mean_return_{k}"),
                  gated(F.stddev_samp, r1, w, k).alias(f"rolling_vol_{k}"),
                  ma.alias(f"ma_{k}"), (c - ma).alias(f"resid_ma_{k}")]
    exprs += [log_ratio(c, o).alias("close_to_open_return"),
              safe_div(h - lo, c).alias("high_low_range"),
              log_ratio(o, F.lag(c, 1).over(w)).alias("gap_return")]
    return base.select("*", *exprs)


def add_volume_rolling(bars: DataFrame, ks: Sequence[int] = VOLUME_KS, volume: str = "volume",
                       asset: str = "asset", date: str = "date") -> DataFrame:
    """log1p volume, volume MA, relative volume and z-score, full windows only."""
    w = asset_window(asset, date)
    v = F.col(volume).cast("double")
    exprs = [F.when(v > -1, F.log1p(v)).alias("log_volume")]
    for k in ks:
        ma = gated(F.avg, v, w, k)
        sd = gated(F.stddev_samp, v, w, k)
        exprs += [ma.alias(f"volume_ma_{k}"), safe_div(v, ma).alias(f"rel_volume_{k}"),
                  safe_div(v - ma, sd).alias(f"volume_z_{k}")]
    return bars.select("*", *exprs)


def market_full(bars: DataFrame, asset: str = "asset", date: str = "date") -> tuple[DataFrame, dict]:
    """All market features in one window stage + the feature-group manifest.

    Groups: ``prices_raw`` (OHLC, adj_close, inc_*), ``returns_rolling`` (19),
    ``volume_rolling`` (10), ``market_full`` (their ordered union).
    """
    df = add_increments(bars, asset=asset, date=date)
    df = add_returns_rolling(df, asset=asset, date=date)
    has_volume = "volume" in bars.columns
    if has_volume:
        df = add_volume_rolling(df, asset=asset, date=date)
    prices_raw = [c for c in ["open", "high", "low", "close", "adj_close"] if c in bars.columns]
    prices_raw += [f"inc_{k}" for k in INC_KS]
    manifest = {
        "prices_raw": prices_raw,
        "returns_rolling": returns_rolling_columns(),
        "volume_rolling": volume_rolling_columns() if has_volume else [],
    }
    manifest["market_full"] = list(dict.fromkeys(
        manifest["prices_raw"] + manifest["returns_rolling"] + manifest["volume_rolling"]))
    return df, manifest


def diff_and_rebuild(bars: DataFrame, test_rows: int = 30, price: str = "close",
                     asset: str = "asset", date: str = "date") -> DataFrame:
    """W11 + W12 + K8: first difference, tail split of the last n rows, and the level
    rebuilt as ``last_train_price + cumsum(diff)`` over the tail (equals the price)."""
    w = asset_window(asset, date)
    w_desc = Window.partitionBy(asset).orderBy(F.col(date).desc())
    df = bars.select(asset, date, price,
                     (F.col(price) - F.lag(price, 1).over(w)).alias("diff"),
                     (F.row_number().over(w_desc) <= test_rows).alias("is_test"))
    cum = Window.partitionBy(asset, "is_test").orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    last_train = F.max(F.when(~F.col("is_test"), F.struct(F.col(date), F.col(price)))).over(
        Window.partitionBy(asset))
    return df.select("*", F.when(F.col("is_test"), last_train[price] + F.sum("diff").over(cum))
                     .alias("rebuilt"))


def clip_date_range(bars: DataFrame, texts: DataFrame, pad_before_days: int = 30, pad_after_days: int = 37,
                    text_date: str = "date", asset: str = "asset") -> DataFrame:
    """Keep bars in ``[min_text - before, max_text + after)`` per asset (end exclusive).

    The per-asset range is a 1-row-per-asset aggregate joined back on ``asset``; the date predicate
    filters the daily bars, after their aggregation (it doesn't reach the tick scan).
    """
    rng = texts.groupBy(asset).agg(F.min(text_date).alias("_lo"), F.max(text_date).alias("_hi"))
    return (bars.join(rng, asset)
            .where((F.col("date") >= F.date_sub("_lo", pad_before_days))
                   & (F.col("date") < F.date_add("_hi", pad_after_days)))
            .drop("_lo", "_hi"))


#: The library's column names and the vendor headers (normalised) that stand for them, best first.
BAR_NAMES = {"adj_close": ["adj_close", "adjclose", "adj-close"], "date": ["date", "datetime", "begin", "timestamp", "index"]}


def ingest_bars(raw: DataFrame, asset: str | None = None) -> DataFrame:
    """Vendor bars to the library's columns.  Two-level headers such as ``('Close', 'AAPL')`` keep
    their first level; names are stripped, lower-cased and underscored.  Of the headers that stand for one of
    BAR_NAMES the best is renamed, and the others keep their own names; the date is floored to the day;
    ``asset`` becomes the key column of a table that lacks one."""
    levels = [re.match(r"""^\(\s*['"]([^'"]*)['"]""", c) for c in raw.columns]
    names = [normalize_name(level[1] if level else c) for level, c in zip(levels, raw.columns)]
    for own, vendor in BAR_NAMES.items():
        best = next((v for v in vendor if v in names), None)
        if best:
            names[names.index(best)] = own
    df = raw.toDF(*names)
    df = df.withColumn("date", F.to_date("date"))
    if asset is not None and "asset" not in names:
        df = df.withColumn("asset", F.lit(asset))
    return df
