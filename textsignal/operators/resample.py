"""Resampling statistics (B1–B4): paired date bootstrap, prediction permutation test,
multiple-comparison adjustment.

Draws are hash-defined (md5 of seed, key, replicate, draw), so results do not
depend on partitioning and are reproducible in any engine.  The test dates of a key
(one row per calendar day) are packed into arrays once; scores are ranked once per key; every replicate is a
vector of multiplicities (or an order) folded in rank order.  Replicates are dealt in
chunks, so only the packed arrays move, never copies of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 100                # replicates of a row that a task gets
METRICS = ("accuracy", "balanced_accuracy", "roc_auc")


def paired_table(preds: DataFrame, base: str, other: str, keys: Sequence[str] = ("asset",), date: str = "date",
                 model: str = "model", y: str = "y_true", score: str = "y_proba") -> DataFrame:
    """One row per (keys, date): truth, base and other scores, date index 0..n-1 and n."""
    keys = list(keys)
    a = preds.where(F.col(model) == base).select(*keys, date, F.col(y).alias("y"), F.col(score).alias("pa"))
    b = preds.where(F.col(model) == other).select(*keys, date, F.col(score).alias("pb"))
    t = a.join(b, keys + [date])
    w = Window.partitionBy(*keys).orderBy(date)
    return t.select("*", (F.row_number().over(w) - 1).cast("long").alias("idx"))


def _hash(text: str) -> int:
    """``functions.columns.hash_uniform`` of the joined parts."""
    return int(md5(text.encode()).hexdigest()[:12], 16)


def weighted_metrics(y: np.ndarray, score: np.ndarray, weight: np.ndarray, threshold: float) -> np.ndarray:
    """(replicates x 3): accuracy, balanced accuracy, exact AUC (ties 1/2) under each row of ``weight``; NaN where a metric
    is not defined."""
    up, hit = y == 1, score >= threshold
    total = lambda mask: weight[:, mask].sum(axis=1)
    tp, tn, pos, neg = total(up & hit), total(~up & ~hit), total(up), total(~up)
    with np.errstate(divide="ignore", invalid="ignore"):
        accuracy = (tp + tn) / weight.sum(axis=1)
        both = (tp / pos + tn / neg) / 2
        balanced = np.where((pos > 0) & (neg > 0), both, np.where(pos > 0, tp / pos, np.where(neg > 0, tn / neg, np.nan)))
        order = np.argsort(score, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(score[order]) != 0))
        p = np.add.reduceat((weight * up)[:, order], starts, axis=1)
        n = np.add.reduceat((weight * ~up)[:, order], starts, axis=1)
        below = np.cumsum(n, axis=1) - n
        auc = np.where((pos > 0) & (neg > 0), (p * (below + 0.5 * n)).sum(axis=1) / (pos * neg), np.nan)
    return np.column_stack([accuracy, balanced, auc])


def _replicates(pairs: DataFrame, keys: Sequence[str], n: int, seed: int, deltas) -> DataFrame:
    """(keys, metric, v, point): ``deltas(row, first, last)`` of every chunk of replicates, beside the deltas of the whole sample."""
    held = F.array_sort(F.collect_list(F.struct("idx", F.col("date").cast("string").alias("day"), F.col("y").cast("int").alias("y"),
                                                F.col("pa").cast("double").alias("pa"), F.col("pb").cast("double").alias("pb"))))
    rows = pairs.groupBy(*keys).agg(held.alias("held"))
    rows = rows.select(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).alias("prefix"), *keys,
                       *[F.col("held")[c].alias(f"_{c}") for c in ("day", "y", "pa", "pb")])
    chunks = F.explode(F.sequence(F.lit(0), F.lit(n - 1), F.lit(CHUNK))).alias("first")
    rows = rows.select("*", chunks).repartition(max(pairs.sparkSession.sparkContext.defaultParallelism, 1), "prefix", "first")

    @F.pandas_udf("array<struct<metric:string,v:double,point:double>>")
    def run(prefix: pd.Series, first: pd.Series, day: pd.Series, y: pd.Series, pa: pd.Series, pb: pd.Series) -> pd.Series:
        out = []
        for head, lo, *cols in zip(prefix, first, day, y, pa, pb):
            d, truth, a, b = cols[0], np.asarray(cols[1]), np.asarray(cols[2], float), np.asarray(cols[3], float)
            v, point = deltas(head, range(lo, min(lo + CHUNK, n)), d, truth, a, b)
            out.append([{"metric": f"delta_{m}", "v": None if np.isnan(x) else float(x), "point": None if np.isnan(q) else float(q)}
                        for row in v for m, x, q in zip(METRICS, row, point)])
        return pd.Series(out)
    values = rows.select(*keys, run("prefix", "first", "_day", "_y", "_pa", "_pb").alias("r"))
    return values.select(*keys, F.inline_outer("r"))       # a plain inline would add a filter on the function's result, ahead of the exchange


def _point(y, a, b, threshold: float) -> np.ndarray:
    one = np.ones((1, len(y)))
    return (weighted_metrics(y, b, one, threshold) - weighted_metrics(y, a, one, threshold))[0]


def paired_bootstrap(pairs: DataFrame, keys: Sequence[str] = ("asset",), n_boot: int = 5000, seed: int = 42,
                     threshold: float = 0.5) -> DataFrame:
    """B1 + B2: resample test dates with replacement, both models on the same draw; summary per
    (keys, metric): point, boot_mean, 2.5 % / 97.5 % percentiles, share > 0, n_boot."""
    keys = list(keys)

    def deltas(head, replicates, day, y, a, b):
        n = len(y)
        times = np.stack([np.bincount([_hash(f"{head}:{r}:{j}") % n for j in range(n)], minlength=n) for r in replicates]).astype(float)
        return weighted_metrics(y, b, times, threshold) - weighted_metrics(y, a, times, threshold), _point(y, a, b, threshold)

    return _replicates(pairs, keys, n_boot, seed, deltas).groupBy(*keys, "metric").agg(
        F.first("point").alias("point"), F.avg("v").alias("boot_mean"),
        F.percentile("v", 0.025).alias("ci_2_5"), F.percentile("v", 0.975).alias("ci_97_5"),
        F.avg((F.col("v") > 0).cast("double")).alias("share_gt_0"), F.count("v").alias("n_boot"))


def permutation_test(pairs: DataFrame, keys: Sequence[str] = ("asset",), n_perm: int = 2000, seed: int = 42,
                     threshold: float = 0.5, metrics: Sequence[str] = ("balanced_accuracy", "roc_auc")) -> DataFrame:
    """Shuffle the other model's (score, prediction) across test dates, truth and base fixed;
    share of shuffles whose delta >= the actual delta (no +1 correction).

    Shuffle r maps the date of rank k to the date whose md5(seed, key, r, date) ranks k."""
    keys = list(keys)

    def deltas(head, replicates, day, y, a, b):
        base = weighted_metrics(y, a, np.ones((1, len(y))), threshold)[0]
        rows = []
        for r in replicates:
            order = np.argsort([_hash(f"{head}:{r}:{t}") for t in day], kind="stable")
            rows.append(weighted_metrics(y, b[order], np.ones((1, len(y))), threshold)[0] - base)
        return np.stack(rows), _point(y, a, b, threshold)

    r = _replicates(pairs, keys, n_perm, seed, deltas).where(F.col("metric").isin(*[f"delta_{m}" for m in metrics]))
    return r.groupBy(*keys, "metric").agg(
        F.first("point").alias("actual_delta"), F.avg("v").alias("perm_mean"),
        F.percentile("v", 0.025).alias("perm_2_5"), F.percentile("v", 0.975).alias("perm_97_5"),
        F.avg((F.col("v") >= F.col("point")).cast("double")).alias("share_ge_actual"), F.count("v").alias("n_perm"))


def adjust_p(pvals: DataFrame, p: str = "p_value", order: Sequence[str] = ()) -> DataFrame:
    """Bonferroni and Benjamini–Hochberg adjusted p-values over all rows (one family).
    The family is a small table (one row per test), so the global window is bounded."""
    w = Window.orderBy(F.col(p), *order)
    m = F.count(F.lit(1)).over(Window.partitionBy())
    x = pvals.select("*", F.row_number().over(w).alias("_i"), m.alias("_m"))
    raw = F.col(p) * F.col("_m") / F.col("_i")
    x = x.withColumn("_raw", raw)
    back = Window.orderBy(F.col("_i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return x.select(*pvals.columns, F.least(F.lit(1.0), F.col(p) * F.col("_m")).alias("bonferroni"),
                    F.least(F.lit(1.0), F.min("_raw").over(back)).alias("bh"))
