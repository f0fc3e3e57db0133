"""Text -> trading-day alignment (A1–A6, J1–J3, J8, J9, W16) without look-ahead.

Daily aggregates are keyed by (asset, date) and partially aggregated before
the shuffle.  The ``[t-first, t-last]`` text window (J3) is rewritten from a
range join into an equi-join: every text day is exploded to the (at most
``first - last + 1``) decision dates that may see it, then joined on
(asset, date) — no nested loop, no cross join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textsignal.functions.columns import explode_computed


def explode_assets(events: DataFrame, asset_list: str = "asset_list") -> DataFrame:
    """P12 for all assets at once: one row per (event, asset)."""
    others = [c for c in events.columns if c != asset_list]
    return events.select(*others, explode_computed(asset_list, "asset"))


def daily_text(events_by_asset: DataFrame, date: str = "event_date") -> DataFrame:
    """A3: text_count, avg/max text length and has_text per (asset, date)."""
    return (events_by_asset.groupBy("asset", F.col(date).alias("date"))
            .agg(F.count(F.lit(1)).alias("text_count"), F.avg("text_len").alias("avg_text_len"),
                 F.max("text_len").alias("max_text_len"))
            .withColumn("has_text", F.lit(1)))


def daily_sentiment(scored_by_asset: DataFrame, date: str = "event_date", s: str = "sentiment") -> DataFrame:
    """A1 + A2 + X11: mean/max score, count, shares of positive/negative texts, uncertainty
    share and negative attention (= count x mean negative share) per (asset, date)."""
    sc = F.col(f"{s}.score")
    g = scored_by_asset.groupBy("asset", F.col(date).alias("date")).agg(
        F.count(F.lit(1)).alias("n_texts"), F.avg(sc).alias("mean_score"), F.max(sc).alias("max_score"),
        F.avg((sc > 0).cast("double")).alias("share_pos"), F.avg((sc < 0).cast("double")).alias("share_neg"),
        F.avg(f"{s}.p_unc").alias("uncertainty"), F.avg(f"{s}.p_neg").alias("mean_p_neg"))
    return g.withColumn("neg_attention", F.col("n_texts") * F.col("mean_p_neg"))


def join_same_day(bars: DataFrame, daily: DataFrame, lag_days: int = 0, fill: Sequence[str] | None = None) -> DataFrame:
    """Bars LEFT JOIN daily text on (asset, date - lag_days); missing -> 0 (T19: lag explicit)."""
    d = daily.withColumn("date", F.date_add("date", lag_days)) if lag_days else daily
    out = bars.join(d, ["asset", "date"], "left")
    cols = fill or [c for c in daily.columns if c not in ("asset", "date")]
    return out.na.fill(0, subset=list(cols))


def join_next_day(bars: DataFrame, daily: DataFrame, fill: Sequence[str] | None = None) -> DataFrame:
    """The text of calendar day d is used on bar d+1 (T13: Friday/Saturday text finds no bar)."""
    return join_same_day(bars, daily, 1, fill)


def lost_text_days(bars: DataFrame, daily: DataFrame, lag_days: int = 1) -> DataFrame:
    """T13 audit: text days whose shifted date has no bar, per asset."""
    d = daily.select("asset", F.date_add("date", lag_days).alias("date"))
    return d.join(bars.select("asset", "date"), ["asset", "date"], "left_anti").groupBy("asset").agg(
        F.count(F.lit(1)).alias("lost_text_days"))


def window_pairs(daily: DataFrame, first: int = 10, last: int = 1) -> DataFrame:
    """Explode each text day d to the decision dates t with t-first <= d <= t-last."""
    return daily.select("*", F.explode(F.sequence(F.lit(last), F.lit(first))).alias("_k")).withColumn(
        "feature_date", F.col("date")).withColumn("date", F.date_add("date", F.col("_k"))).drop("_k")


def feature_dates(bars: DataFrame, daily: DataFrame, first: int = 10, last: int = 1) -> DataFrame:
    """(asset, date, feature_date): the text days that the windows of each decision date really use."""
    return window_pairs(daily.select("asset", "date"), first, last).join(bars.select("asset", "date"), ["asset", "date"], "left_semi")


def text_window(bars: DataFrame, daily: DataFrame, first: int = 10, last: int = 1, score: str = "mean_score",
                count: str = "text_count") -> DataFrame:
    """J3 + A5: per bar, texts dated in [t-first, t-last] (calendar days):
    window_text_count = sum of counts, window_days = text days, window_mean_score = mean of the
    *daily means* (T12: every text day weighs the same); zeros when no text day is in range."""
    p = window_pairs(daily.select("asset", "date", score, count), first, last)
    g = p.groupBy("asset", "date").agg(F.sum(count).alias("window_text_count"),
                                        F.count(F.lit(1)).alias("window_days"),
                                        F.avg(score).alias("window_mean_score"))
    out = bars.join(g, ["asset", "date"], "left").na.fill(0, ["window_text_count", "window_days",
                                                             "window_mean_score"])
    return out.withColumn("window_has_text", (F.col("window_days") > 0).cast("int"))


def daily_vector_mean(rows: DataFrame, keys: Sequence[str], vec: str = "embedding") -> DataFrame:
    """Element-wise mean of an ARRAY<FLOAT> per key with a count (Summarizer is a
    partial aggregate, so a hot key is pre-reduced on every task)."""
    v = rows.select(*keys, array_to_vector(F.col(vec)).alias("_v"))
    g = v.groupBy(*keys).agg(Summarizer.mean(F.col("_v")).alias("_m"), F.count(F.lit(1)).alias("n_texts"))
    return g.select(*keys, vector_to_array("_m").alias("mean_vector"), "n_texts")


def window_vector_mean(bars: DataFrame, daily_vec: DataFrame, dim: int, first: int = 10, last: int = 1) -> DataFrame:
    """A5 for vectors: mean of the daily mean vectors in [t-first, t-last]; zero vector if none."""
    p = window_pairs(daily_vec.select("asset", "date", "mean_vector", "n_texts"), first, last)
    g = daily_vector_mean(p.withColumnRenamed("mean_vector", "_mv"), ["asset", "date"], "_mv")
    w = p.groupBy("asset", "date").agg(F.sum("n_texts").alias("window_text_count"))
    out = bars.join(g.drop("n_texts"), ["asset", "date"], "left").join(w, ["asset", "date"], "left")
    zero = F.array_repeat(F.lit(0.0), dim)
    return out.select("*", F.coalesce("mean_vector", zero).alias("window_vector"),
                      F.coalesce("window_text_count", F.lit(0)).alias("window_texts")).drop(
        "mean_vector", "window_text_count")


def join_date_features(rows: DataFrame, features: DataFrame, date: str) -> DataFrame:
    """Rows LEFT JOIN per-date features; the feature table has one row per calendar day and is
    broadcast, so the rows don't move."""
    return rows.join(F.broadcast(features.withColumnRenamed("date", date)), date, "left")


def text_meta(rows: DataFrame, date: str, vec: str | None = "embedding") -> DataFrame:
    """A6 + F11 (+ T15): embedding_norm per row, rows_per_date = rows of the *table* on the date,
    has_text = 1.  Per-date counts are a partial aggregate; the table has one row per calendar day, so it
    is broadcast and the rows stay where they are (no exchange on a hot date)."""
    from textsignal.functions.columns import l2_norm
    counts = rows.groupBy(date).agg(F.count(F.lit(1)).alias("rows_per_date"))
    out = rows.join(F.broadcast(counts), date)
    if vec:
        out = out.withColumn("embedding_norm", l2_norm(vec))
    return out.withColumn("has_text", F.lit(1))


def sequence_window(bars: DataFrame, values: Sequence[str], max_days: int = 10) -> DataFrame:
    """W16 + F16: the last ``max_days`` rows per (asset, date) as a left-zero-padded array of
    structs (date NULL on padding).  Bounded frame, one window stage."""
    w = Window.partitionBy("asset").orderBy("date").rowsBetween(-(max_days - 1), 0)
    steps = F.collect_list(F.struct(F.col("date").alias("step_date"),
                                    *[F.col(v).cast("double").alias(v) for v in values])).over(w)
    pad = F.struct(F.lit(None).cast("date").alias("step_date"), *[F.lit(0.0).alias(v) for v in values])
    seq = F.concat(F.array_repeat(pad, F.greatest(F.lit(max_days) - F.size(steps), F.lit(0))), steps)
    return bars.select("asset", "date", seq.alias("sequence"))


def flatten_sequence(seq: DataFrame, values: Sequence[str], max_days: int = 10) -> DataFrame:
    """M16 input: the padded window flattened to ``{value}_t{k}`` columns (k = 0 oldest)."""
    cols = [F.col("sequence")[k][v].alias(f"{v}_t{k}") for k in range(max_days) for v in values]
    return seq.select("asset", "date", *cols)
