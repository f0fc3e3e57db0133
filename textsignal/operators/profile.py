"""Dataset research: table profiles (A8–A10, K7), coverage (A7), candidate evaluation
(A11, A12, S11), leaderboard / shortlist / top assets (K3–K5, P15).

All assets and horizons are evaluated in one job: the asset list is exploded,
horizons are a generator column, and the per-candidate price series are
windows partitioned by (table, asset, horizon) over daily rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textsignal.functions.schema import ASSET_HINTS, DATE_HINTS, SOURCE_HINTS, TEXT_HINTS, candidate_columns
from textsignal.operators.prep import exact_quantile
from textsignal.operators.text import _asset_conditions


def profile_table(df: DataFrame, table: str, lexicon: Mapping[str, Sequence[str]]) -> DataFrame:
    """A8 + A9 + A10 + K7: one aggregate pass -> one profile row.

    Columns are found by name hints on the driver (no job).  Date parse rate = share of
    non-null values that parse as timestamps; best date column = highest rate, best text
    column = most non-null then longest mean length (first column wins ties).  Mentions are counted in
    all and per asset of the lexicon (``<asset>_mentions``).  Full scan, not the first 5,000 rows (T16).
    """
    date_cols = candidate_columns(df, DATE_HINTS)
    text_cols = candidate_columns(df, TEXT_HINTS)
    asset_cols, source_cols = candidate_columns(df, ASSET_HINTS), candidate_columns(df, SOURCE_HINTS)
    aggs: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(date_cols):
        parsed = F.try_to_timestamp(F.col(c).cast("string")).cast("timestamp_ntz")
        aggs += [F.count(F.col(c)).alias(f"d{i}_nn"), F.count(parsed).alias(f"d{i}_ok"),
                 F.min(parsed).alias(f"d{i}_min"), F.max(parsed).alias(f"d{i}_max")]
    for i, c in enumerate(text_cols):
        aggs += [F.count(F.col(c)).alias(f"t{i}_nn"), F.avg(F.length(F.col(c).cast("string"))).alias(f"t{i}_len")]
    combo = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in text_cols + asset_cols[:1]]
    if combo:
        txt = F.concat_ws(" ", *combo)
        aggs += [F.count_if(c).alias(f"m{j}") for j, c in enumerate(_asset_conditions(txt, lexicon))]
    row = df.agg(*aggs)
    dates = [F.struct(F.coalesce(F.try_divide(F.col(f"d{i}_ok"), F.col(f"d{i}_nn")), F.lit(0.0)).alias("rate"),
                      F.lit(-i).alias("neg_ord"), F.lit(c).alias("name"), F.col(f"d{i}_min").alias("dmin"),
                      F.col(f"d{i}_max").alias("dmax")) for i, c in enumerate(date_cols)]
    texts = [F.struct(F.col(f"t{i}_nn").alias("nn"), F.coalesce(F.col(f"t{i}_len"), F.lit(0.0)).alias("len"),
                      F.lit(-i).alias("neg_ord"), F.lit(c).alias("name")) for i, c in enumerate(text_cols)]
    best_d = F.array_max(F.array(*dates)) if dates else F.lit(None).cast(
        "struct<rate:double,neg_ord:int,name:string,dmin:timestamp_ntz,dmax:timestamp_ntz>")
    best_t = F.array_max(F.array(*texts)) if texts else F.lit(None).cast(
        "struct<nn:bigint,len:double,neg_ord:int,name:string>")
    per_asset = [(F.col(f"m{j}") if combo else F.lit(0)).cast("long").alias(f"{a}_mentions") for j, a in enumerate(lexicon)]
    mentions = sum((F.col(f"m{j}") for j in range(len(lexicon))), F.lit(0)) if combo else F.lit(0).cast("long")
    rate = F.coalesce(best_d["rate"], F.lit(0.0))
    tlen = F.coalesce(best_t["len"], F.lit(0.0))
    rows = F.col("rows")
    score = (F.least(rows / 10000.0, F.lit(1.0)) * 25 + F.when(rate > 0.8, 25).otherwise(0)
             + F.when(best_t["name"].isNotNull() & (tlen >= 15), 25).otherwise(0)
             + F.least(mentions / F.greatest(rows, F.lit(1)), F.lit(1.0)) * 25)
    return row.select(F.lit(table).alias("table_name"), rows, F.lit(len(df.columns)).alias("n_cols"),
                      best_d["name"].alias("best_date_col"), rate.alias("date_parse_rate"),
                      best_d["dmin"].alias("date_min"), best_d["dmax"].alias("date_max"),
                      best_t["name"].alias("best_text_col"), tlen.alias("best_text_avg_len"),
                      F.lit(", ".join(text_cols)).alias("text_cols"), F.lit(", ".join(asset_cols)).alias("asset_cols"),
                      F.lit(", ".join(source_cols)).alias("source_cols"), *per_asset,
                      mentions.cast("long").alias("asset_mentions_total"), score.cast("double").alias("suitability_score_raw"))


def coverage(events_by_asset: DataFrame, keys: Sequence[str] = ("table_name", "asset"),
             date: str = "event_date") -> DataFrame:
    """n_events, distinct dates, range, mean and median events per active date.
    Two-level aggregate: per (key, date) counts first, so the distinct count is a plain count
    and the median runs over at most one value per calendar day."""
    keys = list(keys)
    daily = events_by_asset.groupBy(*keys, date).agg(F.count(F.lit(1)).alias("n"))
    return daily.groupBy(*keys).agg(
        F.sum("n").alias("n_events"), F.count(F.lit(1)).alias("n_dates"), F.min(date).alias("date_min"),
        F.max(date).alias("date_max"), F.avg("n").alias("avg_events_per_active_date"),
        F.percentile(F.col("n").cast("double"), 0.5).alias("median_events_per_active_date"))


def daily_counts(events_by_asset: DataFrame, table: str = "table_name", date: str = "event_date") -> DataFrame:
    """(table, asset, date, text_count): the small per-day table every candidate step reads."""
    return events_by_asset.groupBy(table, "asset", F.col(date).alias("date")).agg(
        F.count(F.lit(1)).alias("text_count"))


def top_assets(daily: DataFrame, order: Mapping[str, int], n: int = 6, table: str = "table_name") -> DataFrame:
    """K5: the n most mentioned assets per table from the per-day counts; lexicon position
    breaks ties."""
    c = daily.groupBy(table, "asset").agg(F.sum("text_count").alias("n_events"))
    pos = F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))])[F.col("asset")]
    w = Window.partitionBy(table).orderBy(F.col("n_events").desc(), pos)
    return c.select("*", F.row_number().over(w).cast("long").alias("rank")).where(F.col("rank") <= n)


def candidates(bars: DataFrame, daily: DataFrame, picks: DataFrame, horizons: Sequence[int] = (1, 3, 7),
               pad_before: int = 30, pad_after: int = 30, table: str = "table_name") -> DataFrame:
    """A11 + A12 + S11: every (table, asset, horizon) candidate in one job.

    Bars are clipped to ``[min_text - pad_before, max_text + max(h) + pad_after)``; text
    counts join on the same day (T19: the research step uses lag 0); targets use h rows."""
    daily = daily.join(picks.select(table, "asset"), [table, "asset"])
    rng = daily.groupBy(table, "asset").agg(F.min("date").alias("lo"), F.max("date").alias("hi"),
                                            F.count(F.lit(1)).alias("news_dates"))
    hmax = max(horizons)
    px = (bars.join(rng, "asset")
          .where((F.col("date") >= F.date_sub("lo", pad_before)) & (F.col("date") < F.date_add("hi", hmax + pad_after)))
          .select(table, "asset", "date", "close", "news_dates"))
    pr = px.groupBy(table, "asset").agg(F.count(F.lit(1)).alias("price_rows"))
    m = px.join(daily, [table, "asset", "date"], "left").na.fill(0, ["text_count"])
    m = m.select("*", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon"))
    w = Window.partitionBy(table, "asset", "horizon").orderBy("date")
    leads = F.coalesce(*[F.when(F.col("horizon") == h, F.lead("close", h).over(w)) for h in horizons])
    m = m.withColumn("future", leads).where(F.col("future").isNotNull()).withColumn(
        "y", (F.col("future") > F.col("close")).cast("double"))
    active = F.col("text_count") > 0
    g = m.groupBy(table, "asset", "horizon").agg(
        F.first("news_dates").alias("news_dates"),
        F.count_if(active).alias("overlap_news_price_dates"),
        F.sum("text_count").alias("total_news_on_price_dates"),
        F.min("date").alias("date_min"), F.max("date").alias("date_max"),
        F.avg(F.when(active, F.col("y"))).alias("positive_share"))
    g = g.join(pr, [table, "asset"])
    bal = 1.0 - F.coalesce(F.abs(F.col("positive_share") - 0.5), F.lit(0.5)) * 2
    score = (F.least(F.col("overlap_news_price_dates") / 365.0, F.lit(1.0)) * 35
             + F.least(F.col("total_news_on_price_dates") / 5000.0, F.lit(1.0)) * 35
             + bal * 20 + F.least(F.col("news_dates") / 365.0, F.lit(1.0)) * 10)
    return g.select(table, "asset", "horizon", "price_rows", "news_dates", "overlap_news_price_dates",
                    "total_news_on_price_dates", "date_min", "date_max", "positive_share",
                    bal.alias("target_balance_score"), score.alias("suitability_score"))


def leaderboard(cands: DataFrame, n: int = 50, table: str = "table_name") -> DataFrame:
    """K3: top-n candidates by suitability (ties: table, asset, horizon)."""
    return cands.orderBy(F.col("suitability_score").desc(), table, "asset", "horizon").limit(n)


def shortlist(cands: DataFrame, min_dates: int = 30, min_news: int = 100, n: int = 15, fallback: int = 10,
              table: str = "table_name") -> DataFrame:
    """P15 + K4: candidates passing both thresholds (top n), else the overall top ``fallback`` —
    decided inside one query with a window flag instead of a second job."""
    ok = (F.col("overlap_news_price_dates") >= min_dates) & (F.col("total_news_on_price_dates") >= min_news)
    w_all = Window.orderBy(F.col("suitability_score").desc(), table, "asset", "horizon")
    w_ok = Window.partitionBy(ok).orderBy(F.col("suitability_score").desc(), table, "asset", "horizon")
    x = cands.select("*", ok.alias("passes"), F.row_number().over(w_all).alias("_r_all"),
                     F.row_number().over(w_ok).alias("_r_ok"),
                     F.max(ok.cast("int")).over(Window.partitionBy()).alias("_any"))
    keep = F.when(F.col("_any") == 1, F.col("passes") & (F.col("_r_ok") <= n)).otherwise(F.col("_r_all") <= fallback)
    return x.where(keep).drop("_r_all", "_r_ok", "_any")


def text_lengths(df: DataFrame, by: Sequence[str], text: str = "text") -> DataFrame:
    """Non-null texts, mean and exact median length per group."""
    x = df.select(*by, F.length(text).cast("double").alias("x"))
    means = x.groupBy(*by).agg(F.count("x").alias("non_null"), F.avg("x").alias("mean_len"))
    return means.join(exact_quantile(x, by).select(*by, F.col("quantile").alias("median_len")), list(by), "left")
