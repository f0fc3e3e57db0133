"""Queries of the models; those that SQL can't express have property tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from textsignal.operators import align, market, metrics, models, newton, splits, targets
from textsignal.plans import fixtures as fx
from textsignal.plans.registry import register
from textsignal.plans.sql_lib import round_cols
from textsignal.plans.views_sql import with_views
from textsignal.session import materialize
from textsignal.sources.tables import load

GROUPS = ["prices_raw", "returns_rolling", "volume_rolling", "market_full"]


def _bars_long(spark, d):
    """The long bars, written once: fits pass over them many times, and each pass would aggregate all ticks again."""
    return materialize(fx.bars_long(spark, d))


def _features(spark, d):
    mf, man = market.market_full(_bars_long(spark, d))
    # target + date split on the feature frame itself (one bars aggregation, no join back)
    return splits.split_by_date(targets.direction_target(mf, 1), "date"), man


@register("dickey_fuller", with_views(f"""
SELECT asset, n, {round_cols(['slope', 'intercept', 't_stat'])}, t_stat < -2.86 AS stationary FROM (
  SELECT asset, CAST(regr_count(dy, ylag) AS BIGINT) AS n, regr_slope(dy, ylag) AS slope, regr_intercept(dy, ylag) AS intercept,
         regr_slope(dy, ylag) / sqrt((regr_syy(dy, ylag) - regr_sxy(dy, ylag) * regr_sxy(dy, ylag) / regr_sxx(dy, ylag))
                                     / CAST(regr_count(dy, ylag) - 2 AS DOUBLE) / regr_sxx(dy, ylag)) AS t_stat
  FROM (SELECT asset, close - lag(close, 1) OVER w AS dy, lag(close, 1) OVER w AS ylag
        FROM bars_long WINDOW w AS (PARTITION BY asset ORDER BY date)) x
  GROUP BY asset) t""", "bars_long"))
def dickey_fuller(spark, d):
    """Lag-0 Dickey-Fuller t-statistic per asset and the 5 % decision."""
    return models.dickey_fuller(fx.bars_long(spark, d))


@register("logreg_ablation")
def logreg_ablation(spark, d):
    """M6 + M8 + M9 + M12 + E1-E3: L2 logistic regression per market feature group, C and
    threshold tuned on validation, metrics on test."""
    df, man = _features(spark, d)
    res = models.ablation(df, man, GROUPS)
    return res.select("feature_group", "n_features", "selected_C", "selected_threshold", "val_balanced_accuracy",
                      "iterations", "tn", "fp", "fn", "tp", "accuracy", "balanced_accuracy", "precision", "recall", "f1", "roc_auc")


@register("pca_embeddings")
def pca_embeddings(spark, d):
    """M4: train-only standardised PCA of the text embeddings.  Per split and component count (16, 32, 64):
    the variance of the projection per input dimension (on train: the explained share), and the mean
    product of the first two components (on train: 0)."""
    te = fx.text_emb(spark, d)
    te = splits.split_by_date(te.withColumnRenamed("event_date", "date"), "date")
    proj, ev, kk = models.pca_embeddings(te.withColumn("dim", F.size("embedding")), "embedding", 64)
    energy = lambda k: F.aggregate(F.slice("pca", 1, k), F.lit(0.0), lambda a, x: a + x * x) / F.col("dim")
    return proj.groupBy("split").agg(
        F.lit(kk).alias("k_actual"), F.lit(ev).alias("explained_variance"), F.count(F.lit(1)).alias("n_rows"),
        *[F.avg(energy(k)).alias(f"variance_{k}") for k in (16, 32, 64)],
        F.avg(F.get("pca", F.lit(0)) * F.get("pca", F.lit(1))).alias("cross_1_2"))


@register("arx_forecast")
def arx_forecast(spark, d):
    """M14 + M15 + W12 + E8: direct 30-step forecast per asset, of levels or differences as its unit-root test decides, with the volume known at the origin
    as regressor (the long bars and the texts share no dates) and without; levels rebuilt by cumulative
    sums, beside the naive level."""
    b = _bars_long(spark, d)
    plain = models.direct_forecast(b, 30, by_test=True).select("asset", "k", F.col("level_pred").alias("level_plain"))
    return models.direct_forecast(b, 30, exog="volume", by_test=True).join(plain, ["asset", "k"])


@register("mlp_window")
def mlp_window(spark, d):
    """M16 + W16: MLP on the flattened 10-row window of (close, volume); test metrics per asset."""
    b = _bars_long(spark, d)
    seq = align.flatten_sequence(align.sequence_window(b, ["close", "volume"], 10), ["close", "volume"], 10)
    lab = fx.labelled_bars_long(spark, d, b).select("asset", "date", "y", "split")
    df = seq.join(lab, ["asset", "date"])
    cols = [c for c in seq.columns if c not in ("asset", "date")]
    p = models.window_mlp(df, cols)
    return metrics.evaluate(p, ["asset"])


@register("rf_prices")
def rf_prices(spark, d):
    """Random forest on the raw price group; test metrics per asset."""
    df, man = _features(spark, d)
    p = models.random_forest(df, man["prices_raw"])
    return metrics.evaluate(p, ["asset"])


@register("logreg_fixed_c")
def logreg_fixed_c(spark, d):
    """M7: C = 1 and threshold 0.5 (no tuning) on the market_full group, the intercept inside the penalty; test metrics."""
    df, man = _features(spark, d)
    test, sel = models.fit_logreg_group(df, man["market_full"], "market_full", c_grid=(1.0,), threshold=0.5, penalise_intercept=True)
    return metrics.evaluate(test, ["feature_group"]).join(F.broadcast(sel.drop("fit_status", "gradient")), "feature_group")


@register("training_curve")
def training_curve(spark, d):
    """Objective, train loss and validation loss of every iteration of the market fits at every C, and the iteration
    with the smallest validation loss of each."""
    df, man = _features(spark, d)
    rows, groups = models.array_features(df, man, GROUPS)
    return newton.fit_grid(rows, groups).curves().drop("beta")


TEXT_META = ["text_count", "avg_text_len", "max_text_len", "has_text"]
PCA_SIZES = (16, 32, 64)


def _text_groups(spark, d):
    """The labelled event bars with daily text features, mean vectors and their train-fitted components, and
    positions of the feature groups in their array."""
    mf, man = market.market_full(fx.bars(spark, d))
    rows = splits.split_by_date(targets.direction_target(mf, 1), "date")
    # texts are read and tagged once; dates, lengths and assets of the tagged ones feed the counts and the vectors
    tagged = materialize(fx.events_norm(spark, d).select("doc_id", "event_date", "text_len", "asset_list"))
    rows = align.join_same_day(rows, align.daily_text(align.explode_assets(tagged)))
    stored = load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    by_asset = align.explode_assets(tagged.drop("text_len").join(stored, "doc_id")).withColumnRenamed("event_date", "date")
    vectors = materialize(align.daily_vector_mean(by_asset, ["asset", "date"]))
    dim = vectors.agg(F.max(F.size("mean_vector"))).first()[0]
    rows = rows.join(vectors.drop("n_texts"), ["asset", "date"], "left").withColumn(
        "mean_vector", F.coalesce("mean_vector", F.array_repeat(F.lit(0.0), dim)))
    rows = materialize(rows)
    proj, _, kk = models.pca_embeddings(rows.withColumn("vector", F.col("mean_vector")), "vector", max(PCA_SIZES))
    base = list(man["market_full"])
    single = F.array(*[F.col(c).cast("double") for c in base + TEXT_META])
    frame = proj.select("asset", "date", "split", "y", F.concat(single, "mean_vector", "pca").alias("features"))
    market_at, start = list(range(len(base))), len(base) + len(TEXT_META)
    meta, emb, pca = list(range(len(base), start)), list(range(start, start + dim)), list(range(start + dim, start + dim + kk))
    groups = {"market_full": market_at, "text_meta": meta, "market_full_text_meta": market_at + meta, "finbert_full": emb}
    for k in PCA_SIZES:
        groups[f"finbert_pca_{k}"] = pca[:k]
        groups[f"market_full_finbert_pca_{k}"] = market_at + pca[:k]
        groups[f"market_full_finbert_pca_{k}_text_meta"] = market_at + pca[:k] + meta
    return frame, groups


def _text_predictions(spark, d):
    frame, groups = _text_groups(spark, d)
    frame = materialize(frame)
    grid = newton.fit_grid(frame, groups)
    rows = frame.select("asset", "date", "split", F.col("y").alias("y_true"))
    cols = ["asset", "date", "feature_group", "y_true", "y_proba", "y_pred"]
    preds = grid.predictions()
    for name, b in (("majority", metrics.majority_baseline(rows, ["asset"])),
                    ("previous_direction", metrics.previous_direction_baseline(rows, ["asset"]))):
        preds = preds.select(cols).unionByName(b.withColumn("feature_group", F.lit(name)).select(cols))
    return materialize(preds), grid.selection


@register("predictions")
def predictions(spark, d):
    """D10 + U2 + J4: test predictions of every fitted feature group and of both baselines."""
    return _text_predictions(spark, d)[0]


@register("text_ablation")
def text_ablation(spark, d):
    """M12 with text (M4, M6, M8, M9, J5, E1-E3, E5): test metrics per feature group (market, text meta,
    embedding means, their components, and unions) and baseline, and the deltas to the market group."""
    preds, sel = _text_predictions(spark, d)
    ev = materialize(metrics.evaluate(preds, ["feature_group"]))
    market_ba = ev.where("feature_group = 'market_full'").select("balanced_accuracy", "roc_auc").first()
    return ev.join(F.broadcast(sel), "feature_group", "left").select(
        "feature_group", "n_features", "selected_C", "selected_threshold", "val_balanced_accuracy", "tn", "fp", "fn", "tp",
        "accuracy", "balanced_accuracy", "precision", "recall", "f1", "roc_auc",
        (F.col("balanced_accuracy") - F.lit(market_ba["balanced_accuracy"])).alias("delta_balanced_accuracy"),
        (F.col("roc_auc") - F.lit(market_ba["roc_auc"])).alias("delta_roc_auc"))
