"""Models (M4, M6, M7, M9, M12-M17): logistic regressions over feature groups (fitted by ``newton``), PCA of
embeddings, unit-root test, direct multi-step forecast, window MLP and random forest.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textsignal.functions.columns import finite_or_null, indexed_explode
from textsignal.session import materialize
from textsignal.operators import metrics, newton, prep
from textsignal.operators.newton import C_GRID


def standardized_features(df: DataFrame, cols: Sequence[str], split: str = "split",
                          out: str = "features") -> DataFrame:
    """M1 + M2 + P16: train-only median imputation and population-std scaling, assembled into a
    vector.  Statistics come from the distributed exact median / moments (one row per feature)."""
    keys = [c for c in df.columns if c not in set(cols)]
    df = df.select(*keys, *[finite_or_null(F.col(c).cast("double")).alias(c) for c in cols])
    long = prep.to_long(df.where(F.col(split) == "train").select(*cols, F.lit(0).alias("_k")), ["_k"], cols)
    st = {r["feature"]: r for r in prep.fit_stats(long).collect()}
    exprs = []
    for c in cols:
        s = st.get(c)
        x = F.col(c)
        if s is None or s["median"] is None:
            exprs.append(F.lit(0.0).alias(c))
            continue
        exprs.append(((F.coalesce(x, F.lit(s["median"])) - F.lit(s["mean"])) / F.lit(s["scale"])).alias(c))
    x = df.select(*keys, *exprs)
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(x)


def array_features(df: DataFrame, manifest: Mapping[str, Sequence[str]], groups: Sequence[str],
                   keep: Sequence[str] = ("asset", "date", "split", "y")) -> tuple[DataFrame, dict[str, list[int]]]:
    """The columns of all ``groups`` as one array column ``features``, and each group as positions in it; groups without
    columns are skipped."""
    groups = [g for g in groups if manifest.get(g)]
    cols = list(dict.fromkeys(c for g in groups for c in manifest[g]))
    at = {c: i for i, c in enumerate(cols)}
    rows = df.select(*keep, F.array(*[F.col(c).cast("double") for c in cols]).alias("features"))
    return rows, {g: [at[c] for c in manifest[g]] for g in groups}


def fit_logreg_group(df: DataFrame, cols: Sequence[str], group: str, y: str = "y", split: str = "split",
                     c_grid: Sequence[float] = C_GRID, keys: Sequence[str] = ("asset", "date"),
                     max_iter: int = 100, threshold: float | None = None,
                     penalise_intercept: bool = False) -> tuple[DataFrame, DataFrame]:
    """M6-M9 for one group: (test predictions, selection row); see ``newton.fit_grid``.  ``penalise_intercept`` puts the
    constant inside the penalised vector (M7)."""
    rows, groups = array_features(df, {group: cols}, [group], [*keys, split, y])
    grid = newton.fit_grid(rows, groups, y=y, split=split, keys=keys, date=keys[-1], c_grid=c_grid, max_iter=max_iter, threshold=threshold,
                           penalise_intercept=penalise_intercept)
    return materialize(grid.predictions()), grid.selection


def ablation(df: DataFrame, manifest: Mapping[str, Sequence[str]], groups: Sequence[str], **kw) -> DataFrame:
    """One row of test metrics per feature group, with the selected C and threshold."""
    preds, sel = ablation_predictions(df, manifest, groups, **kw)
    return metrics.evaluate(preds, ["feature_group"]).join(F.broadcast(sel), "feature_group")


def ablation_predictions(df: DataFrame, manifest: Mapping[str, Sequence[str]], groups: Sequence[str], y: str = "y",
                         split: str = "split", c_grid: Sequence[float] = C_GRID, max_iter: int = 100,
                         keys: Sequence[str] = ("asset", "date")) -> tuple[DataFrame, DataFrame]:
    """M12 (+ M6, M8, M9): the same classifier over many feature groups, all fits in the same Newton passes; empty groups
    skipped.  Returns the test predictions (keys, feature_group, y_true, y_proba, y_pred) and the selection rows."""
    rows, positions = array_features(df, manifest, groups, [*keys, split, y])
    grid = newton.fit_grid(rows, positions, y=y, split=split, keys=keys, date=keys[-1], c_grid=c_grid, max_iter=max_iter)
    return materialize(grid.predictions()), grid.selection


def pca_embeddings(df: DataFrame, vec: str, k: int, split: str = "split") -> tuple[DataFrame, float, int]:
    """M4: train-only standardisation of the vector dims, then PCA to min(k, d, n_train - 1).

    Means and population deviations come from one ``Summarizer`` pass over the vectors (nothing is
    unpivoted).  Spark's PCA does not centre, so the input is centred first; the sign of a component is
    chosen so that its largest loading is positive (T11).  Components are nested: the first 16 of a
    64-component fit are the 16-component fit."""
    v = df.withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))
    train = F.col(split) == "train"
    s = v.where(train).agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("_v")).alias("s")).select("s.*").first()
    n_train, mean = s["count"], s["mean"].toArray()
    scale = np.sqrt(s["variance"].toArray() * (n_train - 1) / max(n_train, 1))
    scale[scale == 0] = 1.0
    lit = lambda a: F.array(*[F.lit(float(x)) for x in a])
    centred = F.zip_with(F.col(vec).cast("array<double>"), lit(mean), lambda x, m: F.coalesce(x - m, F.lit(0.0)))
    x = v.drop("_v").withColumn("std_vec", array_to_vector(F.zip_with(centred, lit(scale), lambda x, d: x / d)))
    kk = max(1, min(k, len(mean), n_train - 1))
    model = PCA(k=kk, inputCol="std_vec", outputCol="pca").fit(x.where(train))
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(kk)])
    turned = F.zip_with(vector_to_array("pca"), lit(signs), lambda z, g: z * g)
    out = model.transform(x).select(*[c for c in df.columns if c != vec], turned.alias("pca"))
    return out, float(np.sum(model.explainedVariance.toArray())), kk


def dickey_fuller(bars: DataFrame, price: str = "close", asset: str = "asset", date: str = "date",
                  critical: float = -2.86) -> DataFrame:
    """Lag-0 Dickey-Fuller regression dy = a + b*y[t-1] per asset from regr_* aggregates;
    t = b / se(b); 'stationary' when t < the 5 % critical value (no p-value, no lag search)."""
    w = Window.partitionBy(asset).orderBy(date)
    x = bars.select(asset, (F.col(price) - F.lag(price, 1).over(w)).alias("dy"), F.lag(price, 1).over(w).alias("ylag"))
    g = x.groupBy(asset).agg(F.regr_slope("dy", "ylag").alias("slope"), F.regr_intercept("dy", "ylag").alias("intercept"),
                             F.regr_count("dy", "ylag").alias("n"), F.regr_sxx("dy", "ylag").alias("sxx"),
                             F.regr_syy("dy", "ylag").alias("syy"), F.regr_sxy("dy", "ylag").alias("sxy"))
    sse = F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")
    se = F.sqrt(F.try_divide(sse, (F.col("n") - 2).cast("double")) / F.col("sxx"))
    t = F.try_divide(F.col("slope"), se)
    return g.select(asset, "n", "slope", "intercept", t.alias("t_stat"), (t < critical).alias("stationary"))


def direct_forecast(series: DataFrame, steps: int = 30, asset: str = "asset", date: str = "date",
                    value: str = "close", exog: str | None = None, by_test: bool = False) -> DataFrame:
    """M15 (re-aimed SARIMAX): direct multi-step linear autoregression on first differences, or, with ``by_test``, on what the
    unit-root test of each asset's train rows (M14) decides: stationary series are forecast in levels, the others
    (and those too short for the test) in differences; ``differenced`` tells which.

    With x the series so chosen, for each step k the target is x[t+k] and the features are x[t], x[t-1], x[t-7] and, if
    given, the exogenous value known at t.  Each (asset, k) fit is least squares by its normal
    equations: Spark sums the products of all training rows (partial aggregates), and one small system per
    (asset, k) is solved afterwards.  The last ``steps`` rows of each asset are held out; the level is
    rebuilt as last train level + cumulative predicted differences (W12), or is the forecast itself; ``level_naive``
    stays at the last train level (E8)."""
    w = Window.partitionBy(asset).orderBy(date)
    base = series.select(asset, date, value, *([exog] if exog else []),
                         F.row_number().over(Window.partitionBy(asset).orderBy(F.col(date).desc())).alias("rn"))
    tested = base.where(F.col("rn") > steps)
    decided = dickey_fuller(tested, value, asset, date).select(asset, (~F.coalesce("stationary", F.lit(False))).alias("differenced")) \
        if by_test else tested.select(asset).distinct().withColumn("differenced", F.lit(True))
    base = base.join(decided, asset).withColumn(
        "diff", F.when(F.col("differenced"), F.col(value) - F.lag(value, 1).over(w)).otherwise(F.col(value).cast("double")))
    base = base.select("*", F.lag("diff", 1).over(w).alias("d1"), F.lag("diff", 7).over(w).alias("d7"),
                       F.array(*[F.lead("diff", k).over(w) for k in range(1, steps + 1)]).alias("leads"))
    origin = base.where(F.col("rn") == steps + 1).select(asset, "differenced", F.col(value).alias("origin_level"))
    feats = ["diff", "d1", "d7"] + ([exog] if exog else [])
    j = base.select(asset, *feats, "rn", indexed_explode("leads", "k0", "target"))
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in feats]]
    whole = F.col("target").isNotNull()
    for f in feats:
        whole = whole & F.col(f).isNotNull()
    fit = whole & ((F.col("rn") - F.col("k0") - 1) > steps)
    at_origin = F.col("rn") == steps + 1
    p = len(x)
    sums = j.groupBy(asset, (F.col("k0") + 1).alias("k")).agg(
        F.count_if(fit).alias("n_train"),
        F.array(*[F.sum(F.when(fit, x[a] * x[b])) for a in range(p) for b in range(p)]).alias("xx"),
        F.array(*[F.sum(F.when(fit, x[a] * F.col("target"))) for a in range(p)]).alias("xy"),
        F.array(*[F.max(F.when(at_origin, F.coalesce(c, F.lit(0.0)))) for c in x]).alias("xo"),
        F.max(F.when(at_origin, F.col("target"))).alias("actual"))

    @F.pandas_udf("double")
    def solved(n: pd.Series, xx: pd.Series, xy: pd.Series, xo: pd.Series) -> pd.Series:
        out = np.full(len(n), np.nan)
        for i, (rows, a, b, o) in enumerate(zip(n, xx, xy, xo)):
            if rows >= p and all(v is not None and np.isfinite(v) for v in o):
                a, b = np.asarray(a, float).reshape(p, p), np.asarray(b, float)
                unit = 1 / np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))     # well scaled
                beta = unit * np.linalg.lstsq(a * np.outer(unit, unit), unit * b, rcond=None)[0]
                out[i] = float(np.asarray(o, float) @ beta)
        return pd.Series(out)

    res = sums.select(asset, "k", "n_train", solved("n_train", "xx", "xy", "xo").alias("pred"), "actual")
    cum = Window.partitionBy(asset).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)

    def level(c: str):
        return F.when(F.col("differenced"), F.col("origin_level") + F.sum(c).over(cum)).otherwise(F.col(c))
    return res.join(origin, asset).select(
        asset, "k", "differenced", "n_train", "pred", "actual", level("pred").alias("level_pred"), level("actual").alias("level_actual"),
        F.col("origin_level").alias("level_naive"))


def window_mlp(df: DataFrame, cols: Sequence[str], y: str = "y", split: str = "split", hidden: int = 16,
               max_iter: int = 100, seed: int = 42) -> DataFrame:
    """M16 (re-aimed LSTM): MLP over the standardised flattened 10-day window; test predictions."""
    x = standardized_features(df, cols, split)
    mlp = MultilayerPerceptronClassifier(featuresCol="features", labelCol=y, layers=[len(cols), hidden, 2],
                                         maxIter=max_iter, seed=seed)
    m = mlp.fit(x.where(F.col(split) == "train").withColumn(y, F.col(y).cast("double")))
    return (m.transform(x.where(F.col(split) == "test"))
            .select("asset", "date", F.col(y).alias("y_true"), vector_to_array("probability")[1].alias("y_proba"),
                    F.col("prediction").cast("int").alias("y_pred")))


def random_forest(df: DataFrame, cols: Sequence[str], y: str = "y", split: str = "split", trees: int = 50,
                  seed: int = 42) -> DataFrame:
    """Random forest on raw prices; test predictions."""
    x = standardized_features(df, cols, split)
    rf = RandomForestClassifier(featuresCol="features", labelCol=y, numTrees=trees, seed=seed, maxDepth=6)
    m = rf.fit(x.where(F.col(split) == "train").withColumn(y, F.col(y).cast("double")))
    return (m.transform(x.where(F.col(split) == "test"))
            .select("asset", "date", F.col(y).alias("y_true"), vector_to_array("probability")[1].alias("y_proba"),
                    F.col("prediction").cast("int").alias("y_pred")))
