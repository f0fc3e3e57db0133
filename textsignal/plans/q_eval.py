"""Splits, preprocessing and evaluation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textsignal.functions.columns import indexed_explode
from textsignal.operators import align, market, metrics, prep, splits, targets
from textsignal.plans import fixtures as fx
from textsignal.plans.q_market import MARKET_FULL, _inc_sql, _returns_sql, _volume_sql
from textsignal.plans.registry import register
from textsignal.plans.sql_lib import (W, auc_sql, c1_sql, confusion_sql, gated, log_ratio, metric_exprs,
                                      metrics_cols, rnd, round_cols)
from textsignal.plans.views_sql import with_views
from textsignal.session import materialize
from textsignal.sources.tables import load

MCOLS = ["accuracy", "balanced_accuracy", "precision", "recall", "f1"]
CM = ["tn", "fp", "fn", "tp"]


def _lab(spark, d):
    """Labelled long bars (target + date split), materialized once per query: several branches
    (train statistics, test rows, dates) reuse it."""
    return materialize(fx.labelled_bars_long(spark, d))


def _preds(spark, d):
    """The prediction fixture, materialized once per query (confusion, AUC and tuning reuse it)."""
    return materialize(fx.preds(spark, d))


# ------------------------------------------------------------------ splits
@register("split_by_date", with_views("SELECT date, date_rank, split FROM bl_split", "bl_split"))
def split_by_date(spark, d):
    """Script rule on the distinct dates of the labelled long bars."""
    y = targets.direction_target(fx.bars_long(spark, d), 1)
    return splits.date_splits(y, "date", rule="floor_each")


@register("split_by_date_nb", with_views("""
SELECT date, date_rank,
       CASE WHEN date_rank <= floor(n_dates * CAST(0.7 AS DOUBLE)) THEN 'train'
            WHEN date_rank <= floor(n_dates * CAST(0.85 AS DOUBLE)) THEN 'validation' ELSE 'test' END AS split
FROM (SELECT date, row_number() OVER (ORDER BY date) AS date_rank, count(*) OVER () AS n_dates
      FROM (SELECT DISTINCT date FROM bl_y) d) t""", "bl_y"))
def split_by_date_nb(spark, d):
    """Notebook rule int(n*0.70) / int(n*0.85)."""
    y = targets.direction_target(fx.bars_long(spark, d), 1)
    return splits.date_splits(y, "date", rule="floor_cumulative")


@register("split_row_balanced", """
SELECT date, n_rows, rows_before,
       CASE WHEN rows_before < floor(n_total * CAST(0.7 AS DOUBLE)) THEN 'train'
            WHEN rows_before < floor(n_total * CAST(0.85 AS DOUBLE)) THEN 'validation' ELSE 'test' END AS split
FROM (SELECT date, n_rows,
             CAST(coalesce(sum(n_rows) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                  AS BIGINT) AS rows_before,
             CAST(sum(n_rows) OVER () AS BIGINT) AS n_total
      FROM (SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS n_rows FROM lineitem
            WHERE l_shipdate IS NOT NULL GROUP BY 1) a) b""")
def split_row_balanced(spark, d):
    """C4 + W14: row-balanced date split over every lineitem row (by ship date)."""
    li = load(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date"))
    return splits.row_balanced_splits(li, "date")


@register("split_summary", with_views(f"""
SELECT coalesce(split, 'all') AS split, count(*) AS n_rows, count(DISTINCT date) AS n_dates,
       min(date) AS date_min, max(date) AS date_max, CAST(sum(y) AS BIGINT) AS n_positive,
       {rnd('avg(CAST(y AS DOUBLE))')} AS positive_share
FROM labelled GROUP BY ROLLUP (split)""", "labelled"))
def split_summary(spark, d):
    """Per-split and total summary in one rollup."""
    return splits.split_summary(_lab(spark, d), "y")


_OVERLAP_SQL = """
SELECT method, count(*) FILTER (WHERE split = 'train') AS n_train,
       count(*) FILTER (WHERE split = 'validation') AS n_validation,
       count(*) FILTER (WHERE split = 'test') AS n_test,
       max(ov) AS overlap_dates
FROM (SELECT s.*, (SELECT count(*) FROM (SELECT date FROM {src} x WHERE x.method = s.method GROUP BY date
                                         HAVING count(DISTINCT split) > 1) o) AS ov
      FROM {src} s) t
GROUP BY method"""


@register("split_overlap", with_views(_OVERLAP_SQL.format(src="both_splits"), "labelled", extra={"both_splits": """
  SELECT 'by_date' AS method, date, split FROM labelled
  UNION ALL
  SELECT 'by_row' AS method, date,
         CASE WHEN r <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
              WHEN r <= floor(n * CAST(0.85 AS DOUBLE)) THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT date, row_number() OVER (ORDER BY date, asset) AS r, count(*) OVER () AS n FROM labelled) t"""}))
def split_overlap(spark, d):
    """U3 + C3 + C7: split sizes and dates shared by two splits, date split vs legacy row split."""
    lab = _lab(spark, d)
    by_date = lab.select(F.lit("by_date").alias("method"), "date", "split")
    by_row = splits.row_splits(lab.drop("split"), ["date", "asset"]).select(
        F.lit("by_row").alias("method"), "date", "split")
    both = by_date.unionByName(by_row)
    sizes = both.groupBy("method").agg(*[F.count_if(F.col("split") == s).alias(f"n_{s}")
                                         for s in ("train", "validation", "test")])
    over = (both.groupBy("method", "date").agg(F.countDistinct("split").alias("k"))
            .groupBy("method").agg(F.count_if(F.col("k") > 1).alias("overlap_dates")))
    return sizes.join(over, "method")


@register("walk_forward_folds", with_views("""
SELECT fold, fs.split, count(DISTINCT l.date) AS n_dates, min(l.date) AS date_min, max(l.date) AS date_max,
       count(*) AS n_rows, CAST(sum(l.y) AS BIGINT) AS n_positive
FROM (SELECT date, fold, CASE WHEN r <= 500 + fold * 250 THEN 'train'
                              WHEN r <= 500 + fold * 250 + 250 THEN 'test' END AS split
      FROM (SELECT date, r, unnest(range(0, CAST(greatest(floor((n - 500 - 1) / 250) + 1, 0) AS BIGINT))) AS fold
            FROM (SELECT date, row_number() OVER (ORDER BY date) AS r, count(*) OVER () AS n
                  FROM (SELECT DISTINCT date FROM labelled) x) d) f) fs
JOIN labelled l ON fs.date = l.date
WHERE fs.split IS NOT NULL
GROUP BY fold, fs.split""", "labelled"))
def walk_forward_folds(spark, d):
    """Expanding walk-forward folds (500 train dates, then 250-date test steps)."""
    lab = _lab(spark, d).drop("split")
    folds = splits.walk_forward_folds(lab, "date", min_train=500, test_size=250, step=250)
    return (folds.join(lab, "date").groupBy("fold", "split")
            .agg(F.countDistinct("date").alias("n_dates"), F.min("date").alias("date_min"),
                 F.max("date").alias("date_max"), F.count(F.lit(1)).alias("n_rows"),
                 F.sum("y").alias("n_positive")))


@register("leak_checklist", with_views("""
SELECT rule, CAST(v AS BIGINT) AS violations, v = 0 AS ok FROM (
  SELECT 'dates_disjoint' AS rule, count(*) AS v
  FROM (SELECT date FROM labelled GROUP BY date HAVING count(DISTINCT split) > 1) a
  UNION ALL
  SELECT 'target_uses_future', count(*) FILTER (WHERE t.target_date <= l.date)
  FROM labelled l JOIN (SELECT asset, date, lead(date, 1) OVER (PARTITION BY asset ORDER BY date) AS target_date
                        FROM bars_long) t ON l.asset = t.asset AND l.date = t.date
  UNION ALL
  SELECT 'feature_after_decision', count(*) FILTER (WHERE feature_date > date)
  FROM (SELECT b.date, t.date AS feature_date FROM bars b JOIN text_days t ON t.asset = b.asset AND b.date = t.date + INTERVAL 1 DAY
        UNION ALL
        SELECT b.date, t.date FROM text_days t, range(1, 11) r(k) JOIN bars b ON b.asset = t.asset AND b.date = t.date + CAST(r.k AS INTEGER)
       ) f
  UNION ALL
  SELECT 'splits_chronological',
         CASE WHEN max(date) FILTER (WHERE split = 'train') >= min(date) FILTER (WHERE split <> 'train')
              THEN 1 ELSE 0 END
  FROM labelled) r""", "labelled", "bars_long", "bars", "news_by_asset", extra={
    "text_days": "SELECT DISTINCT asset, event_date AS date FROM news_by_asset"}))
def leak_checklist(spark, d):
    """Leak rules as violation counts; the feature dates are those of the texts that the decisions really use: of the
    next-day join (J2) and of the ten-day window (J3)."""
    w = Window.partitionBy("asset").orderBy("date")
    days = fx.news_by_asset(spark, d).select("asset", F.col("event_date").alias("date")).distinct()
    bars = fx.bars(spark, d).select("asset", "date")
    used = align.feature_dates(bars, days, 1, 1).unionByName(align.feature_dates(bars, days, 10, 1))
    td = fx.bars_long(spark, d).select("asset", "date", F.lead("date", 1).over(w).alias("target_date"))
    rows = _lab(spark, d).join(td, ["asset", "date"])
    return splits.leak_checklist(rows, used, target_date="target_date")


# ------------------------------------------------------------------ prep
@register("class_weights", with_views(f"""
SELECT asset, y, n_class,
       {rnd('CAST(sum(n_class) OVER (PARTITION BY asset) AS DOUBLE) / (count(*) OVER (PARTITION BY asset) * n_class)')}
         AS weight
FROM (SELECT asset, y, count(*) AS n_class FROM labelled WHERE split = 'train' GROUP BY 1, 2) c""", "labelled"))
def class_weights(spark, d):
    """M5: balanced class weights on train rows, per asset."""
    return prep.class_weights(_lab(spark, d).where("split = 'train'"), "y", ["asset"])


def _mf_sql() -> str:
    vol = ", ".join(c for c in MARKET_FULL if c.startswith(("log_volume", "volume_", "rel_volume")))
    return (f"SELECT rr.* , {vol} FROM ({_returns_sql().replace('FROM bars_long', 'FROM inc')}) rr "
            f"JOIN (SELECT asset AS a2, date AS d2, {vol} FROM ({_volume_sql()}) v) vv "
            f"ON rr.asset = vv.a2 AND rr.date = vv.d2")


_MF_LONG = {"inc": _inc_sql("bars_long"), "mf": _mf_sql(),
            "mf_long": f"""
  SELECT asset, date, split, feature, x FROM (
    SELECT m.asset, m.date, l.split, {', '.join(f'CAST(m.{c} AS DOUBLE) AS {c}' for c in MARKET_FULL)}
    FROM mf m JOIN labelled l ON m.asset = l.asset AND m.date = l.date) w
  UNPIVOT INCLUDE NULLS (x FOR feature IN ({', '.join(MARKET_FULL)}))""",
            "stats": """
  SELECT feature, median, avg(coalesce(x, median)) AS mean, stddev_pop(coalesce(x, median)) AS std,
         count(*) AS n_train
  FROM (SELECT t.feature, t.x, q.median FROM mf_long t
        JOIN (SELECT feature, quantile_cont(x, 0.5) AS median FROM mf_long WHERE split = 'train'
              GROUP BY feature) q ON t.feature = q.feature
        WHERE t.split = 'train') z
  GROUP BY feature, median"""}


def _mf_long(spark, d):
    mf, man = market.market_full(fx.bars_long(spark, d))
    # target and date split straight on the feature frame: one bars aggregation, no join back
    lab = splits.split_by_date(targets.direction_target(mf, 1), "date")
    # the wide frame feeds the quantile's two passes and the moments: cut its lineage once; the long
    # form is only ever pre-aggregated in the tasks that make it
    wide = materialize(lab.select("asset", "date", "split", *man["market_full"]))
    return prep.to_long(wide, ["asset", "date", "split"], man["market_full"])


@register("train_median_impute", with_views(f"""
SELECT feature, {round_cols(['median', 'mean', 'std'])},
       {rnd('CASE WHEN std > 0 THEN std ELSE 1.0 END')} AS scale, n_train FROM stats""",
                                            "labelled", "bars_long", extra=_MF_LONG))
def train_median_impute(spark, d):
    """M1 + M2 fit: exact train median (distributed), mean and population std per feature."""
    long = _mf_long(spark, d)
    return prep.fit_stats(long.where("split = 'train'"))


@register("train_standardize", with_views(f"""
SELECT split, feature, {rnd('avg(z)')} AS z_mean, {rnd('stddev_pop(z)')} AS z_std, count(*) AS n
FROM (SELECT t.split, t.feature,
             (coalesce(t.x, s.median) - s.mean) / CASE WHEN s.std > 0 THEN s.std ELSE 1.0 END AS z
      FROM mf_long t JOIN stats s ON t.feature = s.feature) u
GROUP BY split, feature""", "labelled", "bars_long", extra=_MF_LONG))
def train_standardize(spark, d):
    """M1 + M2 apply: train-fitted impute + scale on every split (train z has mean 0, std 1)."""
    long = _mf_long(spark, d)
    st = prep.fit_stats(long.where("split = 'train'"))
    z = prep.impute_standardize(long, st)
    return z.groupBy("split", "feature").agg(F.avg("z").alias("z_mean"), F.stddev_pop("z").alias("z_std"),
                                             F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ baselines and metrics
def _metric_select(prefix_cols=()):
    return f"{', '.join(prefix_cols)}{', ' if prefix_cols else ''}{', '.join(CM)}, {metrics_cols()}"


_MAJ = """
  SELECT asset, y AS majority_class FROM (
    SELECT asset, y, row_number() OVER (PARTITION BY asset ORDER BY cnt DESC, y ASC) AS r
    FROM (SELECT asset, y, count(*) AS cnt FROM labelled WHERE split = 'train' GROUP BY 1, 2) a) b
  WHERE r = 1"""


@register("majority_baseline", with_views(f"""
SELECT cm.asset, m.majority_class, {', '.join(CM)}, {metrics_cols()}, {rnd('a.roc_auc')} AS roc_auc
FROM cm JOIN auc a ON cm.asset = a.asset JOIN maj m ON cm.asset = m.asset""", "labelled", extra={
    "maj": _MAJ,
    "t": """SELECT l.asset, l.y AS y_true, m.majority_class AS y_pred, CAST(m.majority_class AS DOUBLE) AS y_proba
            FROM labelled l JOIN maj m ON l.asset = m.asset WHERE l.split = 'test'""",
    "cm": confusion_sql("t", "asset"), "auc": auc_sql("t", "asset")}))
def majority_baseline(spark, d):
    """M10 + A17: train majority class (ties -> 0) evaluated on test, per asset."""
    rows = _lab(spark, d).select("asset", "date", "split", F.col("y").alias("y_true"))
    mb = metrics.majority_baseline(rows, ["asset"])
    ev = metrics.evaluate(mb, ["asset"])
    maj = mb.select("asset", "majority_class").distinct()
    return ev.join(maj, "asset").select("asset", "majority_class", *CM, *MCOLS, "roc_auc")


@register("previous_direction", with_views(f"""
SELECT cm.asset, {', '.join(CM)}, {metrics_cols()}, {rnd('a.roc_auc')} AS roc_auc
FROM cm JOIN auc a ON cm.asset = a.asset""", "labelled", extra={
    "t": """SELECT asset, y AS y_true, prev AS y_pred, CAST(prev AS DOUBLE) AS y_proba FROM (
              SELECT asset, split, y, lag(y, 1) OVER (PARTITION BY asset ORDER BY date) AS prev FROM labelled) x
            WHERE split = 'test' AND prev IS NOT NULL""",
    "cm": confusion_sql("t", "asset"), "auc": auc_sql("t", "asset")}))
def previous_direction(spark, d):
    """M11 + W10: yesterday's direction as today's prediction, test rows, per asset."""
    rows = _lab(spark, d).select("asset", "date", "split", F.col("y").alias("y_true"))
    pd_ = metrics.previous_direction_baseline(rows, ["asset"])
    return metrics.evaluate(pd_, ["asset"]).select("asset", *CM, *MCOLS, "roc_auc")


_STEP = (0.95 - 0.05) / 90
_TUNE = f"""
  SELECT model, asset, tau AS threshold, ba AS val_balanced_accuracy FROM (
    SELECT *, row_number() OVER (PARTITION BY model, asset ORDER BY ba DESC, i ASC) AS r FROM (
      SELECT model, asset, i, tau,
             CASE WHEN (tp + fn) > 0 AND (tn + fp) > 0
                  THEN (CAST(tp AS DOUBLE) / (tp + fn) + CAST(tn AS DOUBLE) / (tn + fp)) / CAST(2.0 AS DOUBLE)
                  WHEN (tp + fn) > 0 THEN CAST(tp AS DOUBLE) / (tp + fn)
                  WHEN (tn + fp) > 0 THEN CAST(tn AS DOUBLE) / (tn + fp) END AS ba
      FROM (SELECT model, asset, i, tau,
                   sum(CASE WHEN s >= tau THEN pos ELSE 0 END) AS tp, sum(CASE WHEN s < tau THEN pos ELSE 0 END) AS fn,
                   sum(CASE WHEN s < tau THEN neg ELSE 0 END) AS tn, sum(CASE WHEN s >= tau THEN neg ELSE 0 END) AS fp
            FROM (SELECT v.*, g.i, CAST(0.05 AS DOUBLE) + CAST(g.i AS DOUBLE) * CAST({_STEP!r} AS DOUBLE) AS tau
                  FROM (SELECT model, asset, y_proba AS s, count(*) FILTER (WHERE y_true = 1) AS pos,
                               count(*) FILTER (WHERE y_true = 0) AS neg
                        FROM preds WHERE split = 'validation' GROUP BY 1, 2, 3) v,
                       (SELECT range AS i FROM range(0, 91)) g) x
            GROUP BY model, asset, i, tau) c) b) a
  WHERE r = 1"""


@register("threshold_tuning", with_views(f"""
SELECT model, asset, {round_cols(['threshold', 'val_balanced_accuracy'])} FROM tuned""", "preds",
                                         extra={"tuned": _TUNE}))
def threshold_tuning(spark, d):
    """M8: best validation balanced accuracy over the 91-value grid; lowest threshold on ties."""
    p = _preds(spark, d).where("split = 'validation'")
    return metrics.tune_threshold(p, ["model", "asset"])


@register("confusion_metrics", with_views(f"""
SELECT cm.model, cm.asset, {rnd('t.threshold')} AS threshold, {', '.join(CM)}, {metrics_cols()}
FROM cm JOIN tuned t ON cm.model = t.model AND cm.asset = t.asset""", "preds", extra={
    "tuned": _TUNE,
    "tp_": """SELECT p.model, p.asset, p.y_true, CAST(p.y_proba >= t.threshold AS INTEGER) AS y_pred
              FROM preds p JOIN tuned t ON p.model = t.model AND p.asset = t.asset WHERE p.split = 'test'""",
    "cm": confusion_sql("tp_", "model, asset")}))
def confusion_metrics(spark, d):
    """E1 + E2 on test at the validation-tuned threshold, per (model, asset)."""
    p = _preds(spark, d)
    tuned = metrics.tune_threshold(p.where("split = 'validation'"), ["model", "asset"])
    test = p.where("split = 'test'").join(tuned, ["model", "asset"]).withColumn(
        "y_pred", (F.col("y_proba") >= F.col("threshold")).cast("int"))
    cm = metrics.classification_metrics(metrics.confusion(test, ["model", "asset"]))
    return cm.join(tuned.select("model", "asset", "threshold"), ["model", "asset"]).select(
        "model", "asset", "threshold", *CM, *MCOLS)


@register("roc_auc_exact", with_views(f"""
SELECT model, asset, split, {rnd('roc_auc')} AS roc_auc FROM ({auc_sql('preds', 'model, asset, split')}) a""",
                                      "preds"))
def roc_auc_exact(spark, d):
    """Exact ROC-AUC (ties 1/2) per (model, asset, split), bucketed prefix sums."""
    return metrics.roc_auc(_preds(spark, d), ["model", "asset", "split"])


def _test_at_half(spark, d):
    return _preds(spark, d).where("split = 'test'").withColumn(
        "y_pred", (F.col("y_proba") >= 0.5).cast("int"))


_T50 = "SELECT *, CAST(y_proba >= 0.5 AS INTEGER) AS y_pred FROM preds WHERE split = 'test'"


@register("class_report", with_views(f"""
SELECT model, label, {round_cols(['precision', 'recall', 'f1'])}, support FROM (
  SELECT model, label, precision, recall, f1, support FROM per
  UNION ALL
  SELECT model, 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM per GROUP BY model
  UNION ALL
  SELECT model, 'weighted avg',
         coalesce(sum(precision * support) / nullif(sum(support), 0), 0),
         coalesce(sum(recall * support) / nullif(sum(support), 0), 0),
         coalesce(sum(f1 * support) / nullif(sum(support), 0), 0), CAST(sum(support) AS BIGINT) FROM per GROUP BY model) u""",
                                     "preds", extra={
    "t50": _T50, "cm": confusion_sql("t50", "model"),
    "per": """
  SELECT model, '0' AS label, coalesce(CAST(tn AS DOUBLE) / nullif(tn + fn, 0), 0) AS precision,
         coalesce(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 0) AS recall,
         coalesce(CAST(2 * tn AS DOUBLE) / nullif(2 * tn + fn + fp, 0), 0) AS f1, CAST(tn + fp AS BIGINT) AS support
  FROM cm
  UNION ALL
  SELECT model, '1', coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0),
         coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0),
         coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0), CAST(tp + fn AS BIGINT) FROM cm"""}))
def class_report(spark, d):
    """Per-class precision/recall/F1/support with macro and weighted averages, per model."""
    return metrics.class_report(_test_at_half(spark, d), ["model"])


@register("date_weighted_metrics", with_views(f"""
SELECT cm.model, {round_cols(CM)}, {metrics_cols()}, {rnd('a.roc_auc')} AS roc_auc
FROM cm JOIN auc a ON cm.model = a.model""", "preds", extra={
    "tw": f"SELECT *, 1.0 / count(*) OVER (PARTITION BY model, date) AS date_weight FROM ({_T50}) t",
    "cm": confusion_sql("tw", "model", w="date_weight"), "auc": auc_sql("tw", "model", w="date_weight")}))
def date_weighted_metrics(spark, d):
    """Rows weighted 1/n_d so every test date counts once, per model."""
    t = metrics.date_weights(_test_at_half(spark, d), ["model"])
    return metrics.evaluate(t, ["model"], weight="date_weight").select("model", *CM, *MCOLS, "roc_auc")


_EV_ALL = {
    "t50": _T50, "cm": confusion_sql("t50", "model, asset"), "auc": auc_sql("t50", "model, asset"),
    "ev": f"""SELECT cm.model, cm.asset, {', '.join(CM)},
                     {', '.join(f'{e} AS {n}' for n, e in metric_exprs())},
                     a.roc_auc
              FROM cm JOIN auc a ON cm.model = a.model AND cm.asset = a.asset"""}


def _ev_all(spark, d):
    return metrics.evaluate(_test_at_half(spark, d), ["model", "asset"])


DELTA = ["accuracy", "balanced_accuracy", "f1", "roc_auc"]


@register("metric_deltas", with_views(f"""
SELECT e.asset, e.model, {', '.join(f"{rnd(f'e.{c} - b.{c}')} AS delta_{c}" for c in DELTA)}
FROM ev e JOIN (SELECT * FROM ev WHERE model = 'market_full') b ON e.asset = b.asset
WHERE e.model <> 'market_full'""", "preds", extra=_EV_ALL))
def metric_deltas(spark, d):
    """E5 + J11: every model minus the market_full baseline on the same asset."""
    return metrics.deltas(_ev_all(spark, d), ["asset"])


PAIRS = [("market_text", "market_full"), ("text", "market_full"), ("market_text", "text")]
PDELTA = ["accuracy", "balanced_accuracy", "roc_auc"]


@register("pairwise_deltas", with_views(f"""
SELECT a.asset, p.model_a, p.model_b, {', '.join(f"{rnd(f'a.{c} - b.{c}')} AS delta_{c}" for c in PDELTA)}
FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in PAIRS)}) p(model_a, model_b)
JOIN ev a ON a.model = p.model_a JOIN ev b ON b.model = p.model_b AND a.asset = b.asset""",
                                        "preds", extra=_EV_ALL))
def pairwise_deltas(spark, d):
    """Named pairwise differences between models, per asset."""
    return metrics.pairwise_deltas(_ev_all(spark, d), PAIRS, ["asset"], cols=PDELTA)


@register("best_text_group", with_views(f"""
SELECT asset, model, {round_cols(['delta_balanced_accuracy', 'delta_roc_auc'])} FROM (
  SELECT e.asset, e.model, e.balanced_accuracy - b.balanced_accuracy AS delta_balanced_accuracy,
         e.roc_auc - b.roc_auc AS delta_roc_auc,
         row_number() OVER (PARTITION BY e.asset ORDER BY e.balanced_accuracy - b.balanced_accuracy DESC NULLS LAST,
                            e.model) AS r
  FROM ev e JOIN (SELECT * FROM ev WHERE model = 'market_full') b ON e.asset = b.asset
  WHERE e.model <> 'market_full') x WHERE r = 1""", "preds", extra=_EV_ALL))
def best_text_group(spark, d):
    """K9: per asset, the text-bearing model with the largest balanced-accuracy gain."""
    dl = metrics.deltas(_ev_all(spark, d), ["asset"])
    return metrics.best_group(dl, ["asset"]).select("asset", "model", "delta_balanced_accuracy", "delta_roc_auc")


@register("metric_leaderboard", with_views(f"""
SELECT model, asset, {round_cols(['accuracy', 'balanced_accuracy', 'roc_auc'])} FROM ev
ORDER BY balanced_accuracy DESC, accuracy DESC, model, asset LIMIT 20""", "preds", extra=_EV_ALL))
def metric_leaderboard(spark, d):
    """K2: top-20 (model, asset) rows by balanced accuracy then accuracy."""
    return metrics.leaderboard(_ev_all(spark, d), 20, tie=("model", "asset")).select(
        "model", "asset", "accuracy", "balanced_accuracy", "roc_auc")


@register("forecast_errors", with_views(f"""
SELECT asset, {round_cols(['mae', 'rmse'])}, n FROM (
  SELECT asset, avg(abs(close - prev)) AS mae, sqrt(avg((close - prev) * (close - prev))) AS rmse, count(close - prev) AS n
  FROM (SELECT asset, close, lag(close, 1) OVER (PARTITION BY asset ORDER BY date) AS prev,
               row_number() OVER (PARTITION BY asset ORDER BY date DESC) AS rd FROM bars_long) t
  WHERE rd <= 30 GROUP BY asset) e""", "bars_long"))
def forecast_errors(spark, d):
    """MAE / RMSE of the naive (previous close) forecast on the 30-row tail of each asset."""
    w = Window.partitionBy("asset").orderBy("date")
    b = fx.bars_long(spark, d).withColumn("prev", F.lag("close", 1).over(w))
    t = splits.tail_split(b, 30).where("split = 'test'")
    return metrics.forecast_errors(t, ["asset"], "close", "prev")


# ------------------------------------------------------------------ flagship
_FLAG = {
    "fb0": f"SELECT *, {log_ratio('close', f'lag(close, 1) {W()}')} AS log_return_1 FROM bars",
    "fb1": f"""SELECT asset, date, close, {gated('avg', 'log_return_1', 5)} AS rm5,
                      lead(close, 1) {W()} AS f1 FROM fb0""",
    "fb": "SELECT asset, date, rm5, CAST(f1 > close AS INTEGER) AS y FROM fb1 WHERE f1 IS NOT NULL",
    "fsplit": c1_sql("fb"),
    "frows": "SELECT fb.*, s.split FROM fb JOIN fsplit s ON fb.date = s.date",
    "fmaj": _MAJ.replace("labelled", "frows"),
    "allm": """
  SELECT 'momentum' AS model, asset, y AS y_true, CAST(coalesce(rm5, 0) > 0 AS INTEGER) AS y_pred,
         CAST(coalesce(rm5, 0) AS DOUBLE) AS y_proba FROM frows WHERE split = 'test'
  UNION ALL
  SELECT 'previous_direction', asset, y, prev, CAST(prev AS DOUBLE) FROM (
    SELECT *, lag(y, 1) OVER (PARTITION BY asset ORDER BY date) AS prev FROM frows) x
  WHERE split = 'test' AND prev IS NOT NULL
  UNION ALL
  SELECT 'majority', r.asset, r.y, m.majority_class, CAST(m.majority_class AS DOUBLE)
  FROM frows r JOIN fmaj m ON r.asset = m.asset WHERE r.split = 'test'""",
    "cm": confusion_sql("allm", "model, asset"), "auc": auc_sql("allm", "model, asset")}


@register("flagship_evaluation", with_views(f"""
SELECT cm.model, cm.asset, tn + fp + fn + tp AS n_test, {', '.join(CM)},
       {metrics_cols(names=('accuracy', 'balanced_accuracy', 'f1'))}, {rnd('a.roc_auc')} AS roc_auc
FROM cm JOIN auc a ON cm.model = a.model AND cm.asset = a.asset""", "bars", extra=_FLAG))
def flagship_evaluation(spark, d):
    """Minimum end-to-end slice: events -> daily bars (A20) -> next-day target (W1) -> rolling
    return feature (W3/W5) -> chronological date split (C1) -> momentum rule, previous
    direction (M11) and majority (M10) -> confusion, accuracy, BA, F1, exact AUC per asset.

    One pass: the previous label is a lag in the same window stage, the train majority is a
    2-row-per-asset aggregate joined back, the three models are exploded into one long frame,
    and metrics are one bounded aggregation per (model, asset) (groups = test dates)."""
    b = market.add_returns_rolling(fx.bars(spark, d), ks=(5,))
    y = targets.direction_target(b, 1)
    w = Window.partitionBy("asset").orderBy("date")
    # daily rows are tiny next to the ticks: one tick scan, then every branch reads this
    rows = materialize(splits.split_by_date(y, "date").select(
        "asset", "date", "split", F.col("y").alias("y_true"), F.col("rolling_mean_return_5").alias("rm5"),
        F.lag("y", 1).over(w).alias("prev")))
    maj = metrics.majority_class(rows.where("split = 'train'"), ["asset"])
    rm5 = F.coalesce("rm5", F.lit(0.0))
    models = F.array(
        F.struct(F.lit("momentum").alias("model"), (rm5 > 0).cast("int").alias("y_pred"), rm5.alias("y_proba")),
        F.struct(F.lit("previous_direction").alias("model"), F.col("prev").cast("int").alias("y_pred"),
                 F.col("prev").cast("double").alias("y_proba")),
        F.struct(F.lit("majority").alias("model"), F.col("majority_class").alias("y_pred"),
                 F.col("majority_class").cast("double").alias("y_proba")))
    allm = (rows.where("split = 'test'").join(maj, "asset")
            .select("asset", "y_true", F.explode(models).alias("m"))
            .select("m.model", "asset", "y_true", "m.y_pred", "m.y_proba")
            .where(F.col("y_pred").isNotNull()))
    cm = metrics.classification_metrics(metrics.confusion(allm, ["model", "asset"]))
    auc = metrics.roc_auc(allm, ["model", "asset"])
    ev = cm.join(auc, ["model", "asset"])
    return ev.select("model", "asset", (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n_test"),
                     *CM, "accuracy", "balanced_accuracy", "f1", "roc_auc")


# ------------------------------------------------------------------ A14, A18, E9, M3
@register("class_counts", with_views("""
SELECT split, y, count(*) AS n_rows, count(DISTINCT date) AS n_dates FROM labelled GROUP BY split, y""", "labelled"))
def class_counts(spark, d):
    """A14 + A18: class counts and distinct dates per split."""
    return _lab(spark, d).groupBy("split", "y").agg(F.count(F.lit(1)).alias("n_rows"),
                                                   F.countDistinct("date").alias("n_dates"))


@register("metrics_report", with_views(f"""
SELECT cm.model, cm.asset, {', '.join(CM)}, {', '.join(f"{rnd(e, 3)} AS {n}" for n, e in metric_exprs())}
FROM cm""", "preds", extra={"t50": _T50, "cm": confusion_sql("t50", "model, asset")}))
def metrics_report(spark, d):
    """The test metric table at threshold 0.5 rounded to 3 decimals (half away from zero on
    the binary value, identical in every engine, T22)."""
    from textsignal.functions.columns import round_half_away
    cm = metrics.classification_metrics(metrics.confusion(_test_at_half(spark, d), ["model", "asset"]))
    return cm.select("model", "asset", *CM, *[round_half_away(F.col(c), 3).alias(c) for c in MCOLS])


_SEQ_FEATS = ["close", "volume"]


def _lags(c: str) -> str:
    return "[" + ", ".join([f"lag({c}, {k}) OVER w" for k in range(9, 0, -1)] + [c]) + "]"


@register("sequence_standardize", with_views(f"""
SELECT split, feature, {rnd('avg(z)')} AS z_mean, {rnd('stddev_pop(z)')} AS z_std, count(*) AS n
FROM (SELECT s.split, s.feature, (s.v - st.m) / CASE WHEN st.sd > 0 THEN st.sd ELSE 1.0 END AS z
      FROM steps s JOIN (SELECT feature, avg(v) AS m, stddev_pop(v) AS sd FROM steps WHERE split = 'train'
                         GROUP BY feature) st ON s.feature = st.feature) x
GROUP BY split, feature""", "labelled", "bars_long", extra={
    "seqs": f"""SELECT b.asset, b.date, l.split, {_lags('b.close')} AS cs, {_lags('CAST(b.volume AS DOUBLE)')} AS vs
                FROM bars_long b LEFT JOIN labelled l ON b.asset = l.asset AND b.date = l.date
                WINDOW w AS (PARTITION BY b.asset ORDER BY b.date)""",
    "steps": """SELECT split, 'close' AS feature, coalesce(cs[i], 0.0) AS v FROM seqs, range(1, 11) r(i)
                WHERE split IS NOT NULL
                UNION ALL
                SELECT split, 'volume', coalesce(vs[i], 0.0) FROM seqs, range(1, 11) r(i) WHERE split IS NOT NULL"""}))
def sequence_standardize(spark, d):
    """M3: standardise the numeric part of the 10-row sequences with mean/std fitted over
    (train rows x steps), padding steps included; summary of z per split and feature."""
    seq = align.sequence_window(fx.bars_long(spark, d), _SEQ_FEATS, 10)
    lab = _lab(spark, d).select("asset", "date", "split")
    rows = seq.join(lab, ["asset", "date"]).select(
        "split", F.transform("sequence", lambda e: F.array(*[e[f] for f in _SEQ_FEATS])).alias("steps"))
    steps = rows.select("split", (F.col("split") == "train").alias("is_train"), F.explode("steps").alias("nums"))
    z = prep.sequence_standardize(steps, "is_train").select("split", indexed_explode("nums", "j", "z"))
    return z.groupBy("split", F.when(F.col("j") == 0, "close").otherwise("volume").alias("feature")).agg(
        F.avg("z").alias("z_mean"), F.stddev_pop("z").alias("z_std"), F.count(F.lit(1)).alias("n"))
