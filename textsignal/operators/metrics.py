"""Evaluation (E1–E9), threshold tuning (M8), baselines (M10, M11), picks (K2, K9).

All metrics are conditional sums in one ``groupBy`` per (model, group) key,
so they are partial aggregates; exact ROC-AUC first reduces predictions to
distinct scores, then runs a bucketed prefix sum so that no single task has
to sort all scores of one model.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textsignal.functions.columns import col_, indexed_explode, threshold_grid


def confusion(preds: DataFrame, by: Sequence[str], y: str = "y_true", pred: str = "y_pred",
              weight: str | None = None) -> DataFrame:
    """Tn, fp, fn, tp per group (weighted sums when ``weight`` is given)."""
    w = F.col(weight).cast("double") if weight else F.lit(1)
    yt, yp = F.col(y), F.col(pred)

    def s(cond: Column) -> Column:
        return F.sum(F.when(cond, w).otherwise(F.lit(0) if not weight else F.lit(0.0)))
    return preds.groupBy(*by).agg(s((yt == 0) & (yp == 0)).alias("tn"), s((yt == 0) & (yp == 1)).alias("fp"),
                                  s((yt == 1) & (yp == 0)).alias("fn"), s((yt == 1) & (yp == 1)).alias("tp"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def balanced_accuracy_expr(tn="tn", fp="fp", fn="fn", tp="tp") -> Column:
    """Mean recall over the classes present (sklearn semantics)."""
    tn, fp, fn, tp = map(col_, (tn, fp, fn, tp))
    pos, neg = tp + fn, tn + fp
    r1 = F.try_divide(tp.cast("double"), pos.cast("double"))
    r0 = F.try_divide(tn.cast("double"), neg.cast("double"))
    return (F.when((pos > 0) & (neg > 0), (r1 + r0) / 2.0)
            .when(pos > 0, r1).when(neg > 0, r0))


def classification_metrics(cm: DataFrame) -> DataFrame:
    """Accuracy, balanced accuracy, precision, recall, F1 (zero division -> 0)."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    prec = _ratio(tp, tp + fp)
    rec = _ratio(tp, tp + fn)
    f1 = _ratio(2 * tp, 2 * tp + fp + fn)
    return cm.select("*", _ratio(tp + tn, n).alias("accuracy"),
                     balanced_accuracy_expr().alias("balanced_accuracy"),
                     prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))


def roc_auc(preds: DataFrame, by: Sequence[str], y: str = "y_true", score: str = "y_proba",
            weight: str | None = None, n_buckets: int = 256) -> DataFrame:
    """Exact ROC-AUC with ties counted 1/2, NULL when a class is missing.  Rows without a score or a
    label take no part, as in the confusion counts.

    1. reduce to distinct (group, score) with positive/negative mass (partial agg);
    2. bucket scores by equal parts of [0, 1] (others go to the first or last), so bucket order = score order;
    3. prefix-sum negatives per bucket (bounded by ``n_buckets`` rows per group);
    4. inside a bucket, a window adds the negatives of lower scores.
    """
    by = list(by)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    d = (preds.select(*by, F.col(score).cast("double").alias("s"), F.col(y).alias("_y"), w.alias("_w"))
         .where(F.col("s").isNotNull() & F.col("_y").isNotNull())
         .groupBy(*by, "s")
         .agg(F.sum(F.when(F.col("_y") == 1, F.col("_w")).otherwise(0.0)).alias("p"),
              F.sum(F.when(F.col("_y") == 0, F.col("_w")).otherwise(0.0)).alias("n")))
    # a fixed monotone map of the score (no per-group min/max pass): bucket order = score order
    b = F.least(F.greatest(F.floor(F.col("s") * n_buckets), F.lit(0)), F.lit(n_buckets - 1))
    d = d.select(*by, "s", "p", "n", b.cast("int").alias("bucket"))
    bt = d.groupBy(*by, "bucket").agg(F.sum("n").alias("bn"))
    wb = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bt = bt.select(*by, "bucket", F.coalesce(F.sum("bn").over(wb), F.lit(0.0)).alias("n_before"))
    d = d.join(bt, by + ["bucket"])
    ws = Window.partitionBy(*by, "bucket").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("n_before") + F.coalesce(F.sum("n").over(ws), F.lit(0.0))
    contrib = d.select(*by, "p", "n", (F.col("p") * (below + 0.5 * F.col("n"))).alias("c"))
    g = contrib.groupBy(*by).agg(F.sum("p").alias("P"), F.sum("n").alias("N"), F.sum("c").alias("C"))
    return g.select(*by, F.when((F.col("P") > 0) & (F.col("N") > 0),
                                F.col("C") / (F.col("P") * F.col("N"))).alias("roc_auc"))


def evaluate(preds: DataFrame, by: Sequence[str], y: str = "y_true", pred: str = "y_pred",
             score: str = "y_proba", weight: str | None = None, n_buckets: int = 256) -> DataFrame:
    """E1 + E2 + E3 in one result row per group."""
    by = list(by)
    m = classification_metrics(confusion(preds, by, y, pred, weight))
    auc = roc_auc(preds, by, y, score, weight, n_buckets)
    return m.join(auc, by, "left")


def tune_threshold(preds: DataFrame, by: Sequence[str], y: str = "y_true", score: str = "y_proba",
                   start: float = 0.05, stop: float = 0.95, n: int = 91) -> DataFrame:
    """M8: the threshold with the best balanced accuracy on validation; the lowest wins ties.

    The 91-value grid is a generator column (J12 without a join); predictions are first
    reduced to counts per distinct score, so the grid multiplies distinct scores, not rows.
    """
    by = list(by)
    s = (preds.groupBy(*by, F.col(score).alias("s"))
         .agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")))
    g = s.select(*by, "s", "pos", "neg", indexed_explode(threshold_grid(start, stop, n), "i", "tau"))
    cm = (g.groupBy(*by, "i", "tau")
          .agg(F.sum(F.when(F.col("s") >= F.col("tau"), F.col("pos")).otherwise(0)).alias("tp"),
               F.sum(F.when(F.col("s") < F.col("tau"), F.col("pos")).otherwise(0)).alias("fn"),
               F.sum(F.when(F.col("s") < F.col("tau"), F.col("neg")).otherwise(0)).alias("tn"),
               F.sum(F.when(F.col("s") >= F.col("tau"), F.col("neg")).otherwise(0)).alias("fp")))
    ba = cm.select(*by, "i", "tau", balanced_accuracy_expr().alias("ba"))
    w = Window.partitionBy(*by).orderBy(F.col("ba").desc(), F.col("i").asc())
    return (ba.select("*", F.row_number().over(w).alias("_r")).where("_r = 1")
            .select(*by, F.col("tau").alias("threshold"), F.col("ba").alias("val_balanced_accuracy")))


def majority_class(train: DataFrame, by: Sequence[str], y: str = "y_true") -> DataFrame:
    """Most frequent class; the smaller class wins ties (T9, code rule)."""
    by = list(by)
    c = train.groupBy(*by, y).agg(F.count(F.lit(1)).alias("cnt"))
    w = Window.partitionBy(*by).orderBy(F.col("cnt").desc(), F.col(y).asc())
    return c.select("*", F.row_number().over(w).alias("_r")).where("_r = 1").select(
        *by, F.col(y).cast("int").alias("majority_class"))


def majority_baseline(rows: DataFrame, by: Sequence[str], y: str = "y_true", split: str = "split") -> DataFrame:
    """Predict the train majority class on test rows (score = class)."""
    by = list(by)
    maj = majority_class(rows.where(F.col(split) == "train"), by, y)
    test = rows.where(F.col(split) == "test").join(maj, by)
    return test.select("*", F.col("majority_class").alias("y_pred"),
                       F.col("majority_class").cast("double").alias("y_proba"))


def previous_direction_baseline(rows: DataFrame, by: Sequence[str], y: str = "y_true", date: str = "date",
                                split: str = "split", lag_rows: int = 1) -> DataFrame:
    """Predict the previous row's label on test rows; rows without one are dropped."""
    w = Window.partitionBy(*by).orderBy(date)
    x = rows.withColumn("_prev", F.lag(y, lag_rows).over(w))
    return (x.where((F.col(split) == "test") & F.col("_prev").isNotNull())
            .select(*rows.columns, F.col("_prev").cast("int").alias("y_pred"),
                    F.col("_prev").cast("double").alias("y_proba")))


def class_report(preds: DataFrame, by: Sequence[str], y: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Per-class precision/recall/F1/support plus macro and weighted averages."""
    by = list(by)
    cm = confusion(preds, by, y, pred)
    rows = []
    for cls, tp, fp, fn in ((0, "tn", "fn", "fp"), (1, "tp", "fp", "fn")):
        tp_, fp_, fn_ = F.col(tp), F.col(fp), F.col(fn)
        rows.append(cm.select(*by, F.lit(str(cls)).alias("label"), _ratio(tp_, tp_ + fp_).alias("precision"),
                              _ratio(tp_, tp_ + fn_).alias("recall"),
                              _ratio(2 * tp_, 2 * tp_ + fp_ + fn_).alias("f1"),
                              (tp_ + fn_).alias("support")))
    per = rows[0].unionByName(rows[1])
    tot = F.sum("support")
    avgs = per.groupBy(*by).agg(
        F.avg("precision").alias("m_p"), F.avg("recall").alias("m_r"), F.avg("f1").alias("m_f"),
        _ratio(F.sum(F.col("precision") * F.col("support")), tot).alias("w_p"),
        _ratio(F.sum(F.col("recall") * F.col("support")), tot).alias("w_r"),
        _ratio(F.sum(F.col("f1") * F.col("support")), tot).alias("w_f"), tot.alias("support"))
    macro = avgs.select(*by, F.lit("macro avg").alias("label"), F.col("m_p").alias("precision"),
                        F.col("m_r").alias("recall"), F.col("m_f").alias("f1"), "support")
    weighted = avgs.select(*by, F.lit("weighted avg").alias("label"), F.col("w_p").alias("precision"),
                           F.col("w_r").alias("recall"), F.col("w_f").alias("f1"), "support")
    return per.unionByName(macro).unionByName(weighted)


def date_weights(preds: DataFrame, by: Sequence[str], date: str = "date") -> DataFrame:
    """Row weight 1/n_d, n_d = rows of the group on that date (so each date weighs 1)."""
    keys = list(by) + [date]
    # partial aggregate, no hot-date window; one row per group and calendar day, so it is broadcast
    n = preds.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nd"))
    return preds.join(F.broadcast(n), keys).withColumn("date_weight", 1.0 / F.col("_nd")).drop("_nd")


def deltas(metrics: DataFrame, keys: Sequence[str], model: str = "model", base: str = "market_full",
           cols: Sequence[str] = ("accuracy", "balanced_accuracy", "f1", "roc_auc")) -> DataFrame:
    """Every model's metrics minus the base model's on the same keys."""
    keys = list(keys)
    b = metrics.where(F.col(model) == base).select(*keys, *[F.col(c).alias(f"_b_{c}") for c in cols])
    return (metrics.where(F.col(model) != base).join(b, keys)
            .select(*keys, model, *[(F.col(c) - F.col(f"_b_{c}")).alias(f"delta_{c}") for c in cols]))


def pairwise_deltas(metrics: DataFrame, pairs: Sequence[tuple[str, str]], keys: Sequence[str],
                    model: str = "model", cols: Sequence[str] = ("accuracy", "balanced_accuracy", "roc_auc")) -> DataFrame:
    """Named differences (a - b) between metric rows, for a fixed list of pairs."""
    keys = list(keys)
    spark = metrics.sparkSession
    pl = spark.createDataFrame(list(pairs), "model_a string, model_b string")
    a = metrics.select(*keys, F.col(model).alias("model_a"), *[F.col(c).alias(f"a_{c}") for c in cols])
    b = metrics.select(*keys, F.col(model).alias("model_b"), *[F.col(c).alias(f"b_{c}") for c in cols])
    return (a.join(F.broadcast(pl), "model_a").join(b, keys + ["model_b"])
            .select(*keys, "model_a", "model_b", *[(F.col(f"a_{c}") - F.col(f"b_{c}")).alias(f"delta_{c}")
                                                  for c in cols]))


def best_group(delta_rows: DataFrame, keys: Sequence[str], model: str = "model",
               by_col: str = "delta_balanced_accuracy") -> DataFrame:
    """K9: best model per key by a delta, model name as tie-break."""
    w = Window.partitionBy(*keys).orderBy(F.col(by_col).desc_nulls_last(), F.col(model).asc())
    return delta_rows.select("*", F.row_number().over(w).alias("_r")).where("_r = 1").drop("_r")


def leaderboard(metrics: DataFrame, n: int = 20, order: Sequence[str] = ("balanced_accuracy", "accuracy"),
                tie: Sequence[str] = ("model",)) -> DataFrame:
    """K2: top-n by (balanced accuracy, accuracy) desc; TakeOrderedAndProject, no full sort."""
    return metrics.orderBy(*[F.col(c).desc_nulls_last() for c in order], *[F.col(c) for c in tie]).limit(n)


def forecast_errors(df: DataFrame, by: Sequence[str], actual: str, pred: str) -> DataFrame:
    """MAE and RMSE per group."""
    e = F.col(actual) - F.col(pred)
    return df.groupBy(*by).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
                               F.count(e).alias("n"))


def bounded_group_metrics(preds: DataFrame, by: Sequence[str], y: str = "y", score: str = "s",
                          weight: str | None = None, threshold: float = 0.5) -> DataFrame:
    """Confusion, accuracy, balanced accuracy and exact AUC per group in ONE aggregation, for
    groups whose *distinct scores* are bounded (e.g. one asset's test dates in a bootstrap
    replicate): reduce to (group, score) masses, collect that bounded sorted list per group and
    fold it once with ``aggregate`` (cumulative negatives give the AUC, the threshold gives the
    confusion counts).  Partitioning on a prefix of ``by`` is reused (no extra exchange)."""
    by = list(by)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    d = (preds.groupBy(*by, F.col(score).cast("double").alias("_s"))
         .agg(F.sum(F.when(F.col(y) == 1, w).otherwise(0.0)).alias("p"),
              F.sum(F.when(F.col(y) == 0, w).otherwise(0.0)).alias("n")))
    g = d.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("_s").alias("s"), "p", "n"))).alias("l"))
    z = F.lit(0.0)
    init = F.struct(z.alias("cn"), z.alias("a"), z.alias("P"), z.alias("N"), z.alias("tp"), z.alias("fp"))
    t = F.lit(threshold)

    def step(acc, e):
        hit = e["s"] >= t
        return F.struct((acc["cn"] + e["n"]).alias("cn"), (acc["a"] + e["p"] * (acc["cn"] + 0.5 * e["n"])).alias("a"),
                        (acc["P"] + e["p"]).alias("P"), (acc["N"] + e["n"]).alias("N"),
                        (acc["tp"] + F.when(hit, e["p"]).otherwise(0.0)).alias("tp"),
                        (acc["fp"] + F.when(hit, e["n"]).otherwise(0.0)).alias("fp"))
    r = g.select(*by, F.aggregate("l", init, step).alias("_agg"))
    tp, fp = F.col("_agg.tp"), F.col("_agg.fp")
    fn, tn = F.col("_agg.P") - tp, F.col("_agg.N") - fp
    out = r.select(*by, tn.alias("tn"), fp.alias("fp"), fn.alias("fn"), tp.alias("tp"),
                   F.when((F.col("_agg.P") > 0) & (F.col("_agg.N") > 0),
                          F.col("_agg.a") / (F.col("_agg.P") * F.col("_agg.N"))).alias("roc_auc"))
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return out.select(*by, "tn", "fp", "fn", "tp", (F.col("tp") + F.col("tn")) / n, balanced_accuracy_expr(), "roc_auc") \
        .toDF(*by, "tn", "fp", "fn", "tp", "accuracy", "balanced_accuracy", "roc_auc")


def filter_groups(df: DataFrame, pattern: str, group: str = "feature_group") -> DataFrame:
    """The rows of the groups whose name matches a regular expression."""
    return df.where(F.col(group).rlike(pattern))
