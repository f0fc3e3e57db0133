"""Market-side queries: A20, W1–W12, W17, S11."""

from __future__ import annotations

from pyspark.sql import functions as F

from textsignal.operators import market, targets
from textsignal.plans import fixtures as fx
from textsignal.plans.registry import register
from textsignal.plans.sql_lib import W, gated, log_ratio, round_cols, rows_frame, safe_div
from textsignal.plans.views_sql import with_views

BAR_COLS = ["open", "high", "low", "close", "adj_close", "volume"]

register("daily_bars", with_views(
    f"SELECT asset, date, {round_cols(BAR_COLS[:-1])}, volume FROM bars", "bars"))(
    lambda spark, d: fx.bars(spark, d))

register("daily_bars_long", with_views(
    f"SELECT asset, date, {round_cols(BAR_COLS)} FROM bars_long", "bars_long"))(
    lambda spark, d: fx.bars_long(spark, d))


@register("next_day_target", with_views(f"""
SELECT asset, date, {round_cols(['close'])}, CAST(f1 > close AS INTEGER) AS y
FROM (SELECT asset, date, close, lead(close, 1) {W()} AS f1 FROM bars) t WHERE f1 IS NOT NULL""", "bars"))
def next_day_target(spark, d):
    """y = 1{close[t+1] > close[t]} per asset; the last row has no target."""
    return targets.direction_target(fx.bars(spark, d), 1).select("asset", "date", "close", "y")


@register("multi_horizon_target", with_views(f"""
SELECT asset, date, {round_cols(['close'])}, horizon, {round_cols(['future_close'])},
       CAST(future_close > close AS INTEGER) AS y
FROM (SELECT asset, date, close, h.horizon,
             CASE h.horizon WHEN 1 THEN f1 WHEN 3 THEN f3 ELSE f7 END AS future_close
      FROM (SELECT asset, date, close, lead(close, 1) {W()} AS f1, lead(close, 3) {W()} AS f3,
                   lead(close, 7) {W()} AS f7 FROM bars) b,
           (VALUES (1), (3), (7)) h(horizon)) t
WHERE future_close IS NOT NULL""", "bars"))
def multi_horizon_target(spark, d):
    """Horizons 1, 3, 7 rows in long form."""
    return targets.multi_horizon_target(fx.bars(spark, d), (1, 3, 7))


def _returns_sql() -> str:
    lr1 = log_ratio("close", f"lag(close, 1) {W()}")
    cols = []
    for k in (2, 5, 10):
        cols += [f"{log_ratio('close', f'lag(close, {k}) {W()}')} AS log_return_{k}",
                 f"{gated('avg', 'log_return_1', k)} AS rolling_mean_return_{k}",
                 f"{gated('stddev_samp', 'log_return_1', k)} AS rolling_vol_{k}",
                 f"{gated('avg', 'close', k)} AS ma_{k}",
                 f"close - {gated('avg', 'close', k)} AS resid_ma_{k}"]
    cols += [f"{log_ratio('close', 'open')} AS close_to_open_return",
             f"{safe_div('high - low', 'close')} AS high_low_range",
             f"{log_ratio('open', f'lag(close, 1) {W()}')} AS gap_return"]
    return f"SELECT *, {', '.join(cols)} FROM (SELECT *, {lr1} AS log_return_1 FROM bars_long) b1"


def _volume_sql(src: str = "bars_long") -> str:
    cols = ["CASE WHEN volume > -1 THEN ln(1 + CAST(volume AS DOUBLE)) END AS log_volume"]
    for k in (5, 10, 20):
        ma, sd = gated("avg", "volume", k), gated("stddev_samp", "volume", k)
        cols += [f"{ma} AS volume_ma_{k}", f"{safe_div('volume', ma)} AS rel_volume_{k}",
                 f"{safe_div(f'volume - {ma}', sd)} AS volume_z_{k}"]
    return f"SELECT *, {', '.join(cols)} FROM {src}"


def _inc_sql(src: str) -> str:
    cols = [f"{safe_div('close', f'lag(close, {k}) {W()}')} - 1 AS inc_{k}" for k in market.INC_KS]
    return f"SELECT *, {', '.join(cols)} FROM {src}"


RET = market.returns_rolling_columns()
VOL = market.volume_rolling_columns()
INC = [f"inc_{k}" for k in market.INC_KS]

register("returns_rolling", with_views(f"SELECT asset, date, {round_cols(RET)} FROM ({_returns_sql()}) r",
                                       "bars_long"))(
    lambda spark, d: market.add_returns_rolling(fx.bars_long(spark, d)).select("asset", "date", *RET))

register("volume_rolling", with_views(f"SELECT asset, date, {round_cols(VOL)} FROM ({_volume_sql()}) v",
                                      "bars_long"))(
    lambda spark, d: market.add_volume_rolling(fx.bars_long(spark, d)).select("asset", "date", *VOL))

register("inc_features", with_views(f"SELECT asset, date, {round_cols(INC)} FROM ({_inc_sql('bars_long')}) i",
                                    "bars_long"))(
    lambda spark, d: market.add_increments(fx.bars_long(spark, d)).select("asset", "date", *INC))


def _market_full_spark(spark, d):
    df, man = market.market_full(fx.bars_long(spark, d))
    return df.select("asset", "date", *man["market_full"])


MARKET_FULL = ["open", "high", "low", "close", "adj_close"] + INC + RET + VOL
register("market_full", with_views(
    f"SELECT asset, date, {round_cols(MARKET_FULL)} FROM ("
    f"SELECT * FROM ({_returns_sql().replace('FROM bars_long', 'FROM inc')}) r) rr "
    f"JOIN (SELECT asset AS a2, date AS d2, {', '.join(VOL)} FROM ({_volume_sql()}) v) vv "
    f"ON rr.asset = vv.a2 AND rr.date = vv.d2",
    "bars_long", extra={"inc": _inc_sql("bars_long")}))(_market_full_spark)


@register("diff_and_rebuild", with_views(f"""
SELECT asset, date, {round_cols(['close', 'diff'])}, is_test,
       {round_cols(['rebuilt'])}
FROM (SELECT *, CASE WHEN is_test THEN
         arg_max(CASE WHEN NOT is_test THEN close END, CASE WHEN NOT is_test THEN date END)
           OVER (PARTITION BY asset)
         + sum(diff) OVER (PARTITION BY asset, is_test ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
       END AS rebuilt
      FROM (SELECT asset, date, close, close - lag(close, 1) {W()} AS diff,
                   row_number() OVER (PARTITION BY asset ORDER BY date DESC) <= 30 AS is_test
            FROM bars_long) t) u""", "bars_long"))
def diff_and_rebuild(spark, d):
    """W11 + W12 + K8: differences, 30-row tail split, level rebuilt by cumulative sum."""
    return market.diff_and_rebuild(fx.bars_long(spark, d), 30)


@register("bars_date_clip", with_views(f"""
SELECT b.asset, b.date, {round_cols(['close'])}
FROM bars b JOIN (SELECT asset, min(event_date) AS lo, max(event_date) AS hi FROM news_by_asset GROUP BY asset) r
  ON b.asset = r.asset
WHERE b.date >= r.lo - INTERVAL 3 DAY AND b.date < r.hi + INTERVAL 2 DAY""", "bars", "news_by_asset"))
def bars_date_clip(spark, d):
    """Bars restricted to the padded per-asset text date range (end exclusive)."""
    nb = fx.news_by_asset(spark, d).select("asset", F.col("event_date").alias("date"))
    return market.clip_date_range(fx.bars(spark, d), nb, pad_before_days=3, pad_after_days=2).select(
        "asset", "date", "close")
