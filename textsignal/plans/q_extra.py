"""Queries of the ingest, cleaning, audit and grid operators (S10, P6, P7, P14, W13, J5, A9, C7, T21, M13 + S15)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textsignal.operators import align, market, metrics, newton, profile, splits, targets, text
from textsignal.plans import fixtures as fx
from textsignal.plans.registry import register
from textsignal.plans.sql_lib import rnd, round_cols
from textsignal.plans.views_sql import with_views
from textsignal.session import materialize
from textsignal.sources import files
from textsignal.sources.tables import load

PURGE_DAYS = 5
MIN_GRID_DATES = 60


@register("bars_ingest", with_views(f"""
SELECT asset, date, {round_cols(['open', 'high', 'low', 'close', 'adj_close'])}, {rnd('volume')} AS volume FROM bars_long""",
                                    "bars_long"))
def bars_ingest(spark, d):
    """Bars with vendor headers (two-level, blanks, capitals) and time stamps, normalised."""
    b = fx.bars_long(spark, d)
    stamp = F.timestamp_add("HOUR", F.lit(16), F.col("date").cast("timestamp_ntz"))
    raw = b.select("asset", stamp.alias("Date"), F.col("open").alias("Open"), F.col("high").alias("('High', 'X')"),
                   F.col("low").alias(" Low "), F.col("close").alias("('Close', 'X')"), F.col("adj_close").alias("Adj Close"),
                   F.col("volume").cast("double").alias("Volume"))
    return market.ingest_bars(raw)


@register("coerced_target", """
SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, CAST(o_orderkey % 2 AS INTEGER) AS y FROM orders
WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 11 <> 0""")
def coerced_target(spark, d):
    """P6 + P7: rows whose date can be read and whose target is a finite number."""
    k = F.col("o_orderkey")
    raw = load(spark, d, "orders").select(
        k.alias("id"), F.when(k % 7 == 0, "not a date").otherwise(F.to_date("o_orderdate").cast("string")).alias("date"),
        F.when(k % 5 == 0, F.lit(None)).when(k % 11 == 0, F.lit(float("inf"))).otherwise((k % 2).cast("double")).alias("y"))
    return targets.ensure_target(targets.coerce_dates(raw, "date"), "y")


@register("first_row_per_day", f"""
SELECT event_type AS asset, CAST(ts AS DATE) AS date, min(ts) AS ts, {rnd('arg_min(value, (ts, value))')} AS value
FROM events GROUP BY 1, 2""")
def first_row_per_day(spark, d):
    """The first tick of each (asset, date) in a total order."""
    e = load(spark, d, "events").select(F.col("event_type").alias("asset"), F.to_date("ts").alias("date"), "ts", "value")
    return targets.first_per_key(e, ["asset", "date"], ["ts"])


@register("rows_with_market", with_views(f"""
SELECT t.doc_id, t.event_date, {rnd('m.market_close')} AS market_close, m.market_volume
FROM text_emb t LEFT JOIN (SELECT date, avg(close) AS market_close, CAST(sum(volume) AS BIGINT) AS market_volume FROM bars GROUP BY date) m
  ON m.date = t.event_date""", "text_emb", "bars"))
def rows_with_market(spark, d):
    """Text rows with the market features of their date."""
    per = fx.bars(spark, d).groupBy("date").agg(F.avg("close").alias("market_close"),
                                                F.sum("volume").cast("long").alias("market_volume"))
    t = fx.text_emb(spark, d).select("doc_id", "event_date")
    return align.join_date_features(t, per, "event_date").select("doc_id", "event_date", "market_close", "market_volume")


@register("text_lengths", f"""
SELECT lang, count(text) AS non_null, {rnd('avg(length(text))')} AS mean_len, {rnd('median(length(text))')} AS median_len
FROM documents GROUP BY lang""")
def text_lengths(spark, d):
    """Texts, mean and exact median length per language."""
    return profile.text_lengths(load(spark, d, "documents"), ["lang"])


@register("split_audit_rows", with_views("""
SELECT l.asset, l.date AS decision_date, t.target_date, l.split, coalesce(s.split <> l.split, FALSE) AS crosses
FROM labelled l
JOIN (SELECT asset, date, lead(date, 1) OVER (PARTITION BY asset ORDER BY date) AS target_date FROM bars_long) t
  ON l.asset = t.asset AND l.date = t.date
LEFT JOIN bl_split s ON s.date = t.target_date""", "labelled", "bars_long", "bl_split"))
def split_audit_rows(spark, d):
    """Decision date, target date and split of every labelled row, and whether they cross."""
    w = Window.partitionBy("asset").orderBy("date")
    when = fx.bars_long(spark, d).select("asset", "date", F.lead("date", 1).over(w).alias("target_date"))
    return splits.split_audit(fx.labelled_bars_long(spark, d).join(when, ["asset", "date"]), "target_date")


@register("purged_split", with_views(f"""
SELECT split, count(*) AS n_rows, max(date) AS date_max
FROM (SELECT l.*, b.v0, b.t0 FROM labelled l, (SELECT min(date) FILTER (split = 'validation') AS v0,
                                                      min(date) FILTER (split = 'test') AS t0 FROM labelled) b) x
WHERE NOT (split = 'train' AND date + INTERVAL {PURGE_DAYS} DAY >= v0)
  AND NOT (split = 'validation' AND date + INTERVAL {PURGE_DAYS} DAY >= t0)
GROUP BY split""", "labelled"))
def purged_split(spark, d):
    """Split sizes after purging the rows whose label may reach into the next split."""
    return splits.purge(fx.labelled_bars_long(spark, d), PURGE_DAYS).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("date").alias("date_max"))


@register("group_filter", with_views(f"""
SELECT model, count(*) AS n_rows, {rnd('avg(y_proba)')} AS mean_score FROM preds
WHERE regexp_matches(model, '^market') GROUP BY model""", "preds"))
def group_filter(spark, d):
    """Predictions of the groups whose name matches a pattern."""
    return metrics.filter_groups(fx.preds(spark, d), "^market", "model").groupBy("model").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("y_proba").alias("mean_score"))


@register("grid_cells", with_views(f"""
SELECT source, asset, horizon, CASE WHEN count(*) >= {MIN_GRID_DATES} THEN 'ok' ELSE 'too_few_dates' END AS status,
       count(*) AS n_rows, count(DISTINCT date) AS n_dates, {rnd('avg(CASE WHEN f > close THEN 1.0 ELSE 0.0 END)')} AS share_up
FROM ({' UNION ALL '.join(f"SELECT source, asset, date, close, {h} AS horizon, lead(close, {h}) OVER (PARTITION BY source, asset ORDER BY date) AS f FROM g" for h in (1, 3, 7))}) x
WHERE f IS NOT NULL GROUP BY 1, 2, 3""", "bars", "bars_long", extra={"g": """
  SELECT 'events' AS source, asset, date, close FROM bars UNION ALL SELECT 'lineitem', asset, date, close FROM bars_long"""}))
def grid_cells(spark, d):
    """Counts over the grid source x asset x horizon: rows, dates, status and share of rises of every cell, from one pass over
    each source (``experiment_grid`` fits them)."""
    cells = None
    for source, b in (("events", fx.bars(spark, d)), ("lineitem", fx.bars_long(spark, d))):
        t = targets.multi_horizon_target(b, (1, 3, 7)).where(F.col("future_close").isNotNull()).withColumn("source", F.lit(source))
        t = t.select("source", "asset", "date", "horizon", "y")
        cells = t if cells is None else cells.unionByName(t)
    g = cells.groupBy("source", "asset", "horizon").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("date").alias("n_dates"),
                                                        F.avg(F.col("y").cast("double")).alias("share_up"))
    return g.withColumn("status", F.when(F.col("n_rows") >= MIN_GRID_DATES, "ok").otherwise("too_few_dates"))


HORIZONS = (1, 3, 7)
TEXT_FEATURES = ["text_count", "avg_text_len", "max_text_len", "has_text"]
SENTIMENT_FEATURES = ["mean_score", "max_score", "share_pos", "share_neg", "uncertainty", "neg_attention"]


def grid_rows(spark, d):
    """(rows, positions of the feature groups): the bars of every source with market and text features, computed once,
    labelled for every horizon and split by the dates of each cell."""
    scored = text.score_text(fx.events_norm(spark, d), "text", lexicon=fx.SENTIMENT_LEXICON)
    scored = materialize(align.explode_assets(scored.select("asset_list", "event_date", "text_len", "sentiment")))     # texts are scored once
    daily = align.daily_text(scored).join(align.daily_sentiment(scored).drop("n_texts"), ["asset", "date"])
    rows, groups = None, {}
    for source, b in (("events", fx.bars(spark, d)), ("lineitem", fx.bars_long(spark, d))):
        mf, man = market.market_full(b)
        frame = align.join_same_day(mf, daily.select("asset", "date", *TEXT_FEATURES, *SENTIMENT_FEATURES))
        cols = [*man["market_full"], *TEXT_FEATURES, *SENTIMENT_FEATURES]
        frame = frame.select("asset", "date", "close", F.array(*[F.col(c).cast("double") for c in cols]).alias("features"))
        frame = targets.multi_horizon_target(frame, HORIZONS, keep=["features"])
        frame = frame.select(F.lit(source).alias("source"), "asset", "horizon", "date", "y", "features")
        rows = frame if rows is None else rows.unionByName(frame)
        n = len(man["market_full"])
        groups = {"market_full": list(range(n)), "sentiment": list(range(n + 4, n + 10)), "text_meta": list(range(n, n + 4)),
                  "market_full_text_meta": list(range(n + 4)), "market_full_sentiment_text_meta": list(range(n + 10))}
    return splits.split_by_date_within(rows, ["source", "asset", "horizon"]), groups


def fitted_grid(spark, d):
    rows, groups = grid_rows(spark, d)
    return newton.fit_grid(rows, groups, by=["source", "asset", "horizon"], keys=["source", "asset", "horizon", "date"],
                           min_dates=MIN_GRID_DATES)


def grid_report(grid, base="market_full"):
    """One row of test metrics per cell and feature group, with the delta to the group ``base`` of the cell; a cell that was
    not fitted has one row with its status and error."""
    by = list(grid.by)
    ev = metrics.evaluate(materialize(grid.predictions()), [*by, "feature_group"])
    first = ev.where(F.col("feature_group") == base).select(*by, F.col("balanced_accuracy").alias("_ba"))
    ev = ev.join(grid.selection.drop("gradient"), [*by, "feature_group"]).join(first, by, "left").withColumn(
        "delta_balanced_accuracy", F.col("balanced_accuracy") - F.col("_ba")).drop("_ba")
    return grid.cells.drop("cell").join(ev, by, "left")


@register("experiment_grid")
def experiment_grid(spark, d):
    """Market and text groups fitted in every cell source x asset x horizon by the same Newton passes; status, error,
    selection and test metrics."""
    return grid_report(fitted_grid(spark, d))


@register("experiment_log", with_views(f"""
SELECT source, asset, horizon, status, n_rows, n_dates, CAST(NULL AS VARCHAR) AS out_dir,
  CASE status WHEN 'too_few_dates' THEN n_dates || ' of {MIN_GRID_DATES} dates'
    WHEN 'empty_split' THEN n_train || ' train, ' || n_val || ' validation, ' || n_test || ' test rows'
    WHEN 'one_class' THEN 'train holds ' || n0 || ' falls and ' || n1 || ' rises' END AS error
FROM (SELECT *, CASE WHEN n_dates < {MIN_GRID_DATES} THEN 'too_few_dates' WHEN n_train = 0 OR n_val = 0 OR n_test = 0 THEN 'empty_split'
        WHEN n0 = 0 OR n1 = 0 THEN 'one_class' ELSE 'ok' END AS status
  FROM (SELECT source, asset, horizon, count(*) AS n_rows, count(DISTINCT date) AS n_dates, count(*) FILTER (r <= t) AS n_train,
          count(*) FILTER (r > t AND r <= t + v) AS n_val, count(*) FILTER (r > t + v) AS n_test,
          count(*) FILTER (r <= t AND f <= close) AS n0, count(*) FILTER (r <= t AND f > close) AS n1
    FROM (SELECT *, CASE WHEN t0 + v0 >= n THEN greatest(1, n - 2) ELSE t0 END AS t, CASE WHEN t0 + v0 >= n THEN 1 ELSE v0 END AS v
      FROM (SELECT *, greatest(1, floor(n * 0.7::DOUBLE)) AS t0, greatest(1, floor(n * 0.15::DOUBLE)) AS v0
        FROM (SELECT *, dense_rank() OVER (PARTITION BY source, asset, horizon ORDER BY date) AS r,
                count(*) OVER (PARTITION BY source, asset, horizon) AS n
          FROM ({' UNION ALL '.join(f"SELECT source, asset, date, close, {h} AS horizon, lead(close, {h}) OVER (PARTITION BY source, asset ORDER BY date) AS f FROM g" for h in HORIZONS)}) a
          WHERE f IS NOT NULL) b) c) e GROUP BY 1, 2, 3) h) i""", "bars", "bars_long", extra={"g": """
  SELECT 'events' AS source, asset, date, close FROM bars WHERE close IS NOT NULL
  UNION ALL SELECT 'lineitem', asset, date, close FROM bars_long WHERE close IS NOT NULL"""}))
def experiment_log(spark, d):
    """The run log of the fitted grid: one row per cell with status, rows, dates and error."""
    return files.run_log(fitted_grid(spark, d).cells)
