"""Resampling queries (B1–B4) on the test predictions of market_full (base) vs text."""

from __future__ import annotations

from pyspark.sql import functions as F

from textsignal.operators import resample
from textsignal.plans import fixtures as fx
from textsignal.plans.registry import register
from textsignal.plans.sql_lib import auc_sql, confusion_sql, round_cols
from textsignal.plans.views_sql import hash_sql, with_views
from textsignal.session import materialize

N_BOOT, N_PERM, SEED = 5000, 2000, 42


def _pairs(spark, d):
    """Test pairs (one row per asset and test date) — reused by the replicate and point
    branches, so the lineage (lineitem -> bars -> target -> split -> scores) is cut once."""
    p = fx.preds(spark, d).where("split = 'test'")
    return materialize(resample.paired_table(p, "market_full", "text", ["asset"]))


_PAIRS = """
  SELECT a.asset, a.date, a.y_true AS y, a.y_proba AS pa, b.y_proba AS pb,
         row_number() OVER (PARTITION BY a.asset ORDER BY a.date) - 1 AS idx
  FROM preds a JOIN preds b ON a.asset = b.asset AND a.date = b.date
  WHERE a.model = 'market_full' AND b.model = 'text' AND a.split = 'test' AND b.split = 'test'"""


def _metric_ctes(prefix: str, src: str, by: str, w: str | None) -> dict[str, str]:
    """long -> confusion + AUC -> per-(by, which) accuracy / BA / AUC -> deltas other - base."""
    cm, auc = confusion_sql(src, f"{by}, which", "y", "y_pred", w), auc_sql(src, f"{by}, which", "y", "s", w)
    on = " AND ".join(f"c.{k.strip()} = a.{k.strip()}" for k in (by + ", which").split(","))
    n = "(tn + fp + fn + tp)"
    ba = ("CASE WHEN (tp + fn) > 0 AND (tn + fp) > 0 THEN (CAST(tp AS DOUBLE) / (tp + fn) + CAST(tn AS DOUBLE) / "
          "(tn + fp)) / CAST(2.0 AS DOUBLE) WHEN (tp + fn) > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) "
          "WHEN (tn + fp) > 0 THEN CAST(tn AS DOUBLE) / (tn + fp) END")
    keys = [k.strip() for k in by.split(",")]
    jk = " AND ".join(f"x.{k} = y2.{k}" for k in keys)
    return {
        f"{prefix}_m": f"""
  SELECT {', '.join('c.' + k for k in keys)}, c.which, CAST(tp + tn AS DOUBLE) / CAST({n} AS DOUBLE) AS accuracy,
         {ba} AS balanced_accuracy, a.roc_auc
  FROM ({cm}) c LEFT JOIN ({auc}) a ON {on}""",
        f"{prefix}_d": f"""
  SELECT {', '.join('x.' + k for k in keys)}, y2.accuracy - x.accuracy AS delta_accuracy,
         y2.balanced_accuracy - x.balanced_accuracy AS delta_balanced_accuracy, y2.roc_auc - x.roc_auc AS delta_roc_auc
  FROM (SELECT * FROM {prefix}_m WHERE which = 'base') x JOIN (SELECT * FROM {prefix}_m WHERE which = 'other') y2
    ON {jk}"""}


def _long_sql(src: str, extra: str = "") -> str:
    e = f"{extra}, " if extra else ""
    return f"""
  SELECT asset, {e}y, 'base' AS which, pa AS s, CAST(pa >= 0.5 AS INTEGER) AS y_pred FROM {src}
  UNION ALL SELECT asset, {e}y, 'other' AS which, pb AS s, CAST(pb >= 0.5 AS INTEGER) AS y_pred FROM {src}"""


def _stack(src: str, rep: str) -> str:
    return " UNION ALL ".join(f"SELECT asset, {rep}, 'delta_{c}' AS metric, delta_{c} AS v FROM {src}"
                              for c in ("accuracy", "balanced_accuracy", "roc_auc"))


_POINT = {"pairs": _PAIRS, "plong": _long_sql("pairs"), **_metric_ctes("pt", "plong", "asset", None),
          "pt_s": " UNION ALL ".join(f"SELECT asset, 'delta_{c}' AS metric, delta_{c} AS point FROM pt_d"
                                     for c in ("accuracy", "balanced_accuracy", "roc_auc"))}

_BOOT = {
    **_POINT,
    "nn": "SELECT asset, count(*) AS n FROM pairs GROUP BY asset",
    "draws": f"""
  SELECT asset, n, b, unnest(range(0, n)) AS j FROM (SELECT asset, n, unnest(range(0, {N_BOOT})) AS b FROM nn) x""",
    "mult": f"""
  SELECT asset, b, {hash_sql(repr(str(SEED)), 'asset', 'CAST(b AS VARCHAR)', 'CAST(j AS VARCHAR)')} % n AS idx,
         count(*) AS m FROM draws GROUP BY 1, 2, 3""",
    "bx": "SELECT m.asset, m.b, m.m, p.y, p.pa, p.pb FROM mult m JOIN pairs p ON m.asset = p.asset AND m.idx = p.idx",
    "blong": _long_sql("bx", "b, m"),
    **_metric_ctes("bt", "blong", "asset, b", "CAST(m AS DOUBLE)"),
    "bs": _stack("bt_d", "b"),
}


@register("bootstrap_delta_ci", with_views(f"""
SELECT s.asset, s.metric, {round_cols(['point', 'boot_mean', 'ci_2_5', 'ci_97_5', 'share_gt_0'])}, n_boot FROM (
  SELECT bs.asset, bs.metric, first(p.point) AS point, avg(v) AS boot_mean, quantile_cont(v, 0.025) AS ci_2_5,
         quantile_cont(v, 0.975) AS ci_97_5, avg(CAST(v > 0 AS DOUBLE)) AS share_gt_0, count(v) AS n_boot
  FROM bs JOIN pt_s p ON bs.asset = p.asset AND bs.metric = p.metric GROUP BY 1, 2) s""", "preds", extra=_BOOT))
def bootstrap_delta_ci(spark, d):
    """B1 + B2: 5,000 paired date-bootstrap replicates of text - market_full (accuracy, BA, AUC)."""
    return resample.paired_bootstrap(_pairs(spark, d), ["asset"], N_BOOT, SEED)


_PERM = {
    **_POINT,
    "perm": f"SELECT asset, date, pb AS pb_src, unnest(range(0, {N_PERM})) AS r FROM pairs",
    "ranked": f"""
  SELECT asset, r, pb_src, row_number() OVER (PARTITION BY asset, r ORDER BY
           {hash_sql(repr(str(SEED)), 'asset', 'CAST(r AS VARCHAR)', 'CAST(date AS VARCHAR)')}, date) - 1 AS idx
  FROM perm""",
    "px": "SELECT k.asset, k.r, p.y, p.pa, k.pb_src AS pb FROM ranked k JOIN pairs p ON k.asset = p.asset AND k.idx = p.idx",
    "plong2": _long_sql("px", "r"),
    **_metric_ctes("pm", "plong2", "asset, r", None),
    "ps": _stack("pm_d", "r"),
    "perm_summary": """
  SELECT ps.asset, ps.metric, first(p.point) AS actual_delta, avg(v) AS perm_mean, quantile_cont(v, 0.025) AS perm_2_5,
         quantile_cont(v, 0.975) AS perm_97_5, avg(CAST(v >= p.point AS DOUBLE)) AS share_ge_actual, count(v) AS n_perm
  FROM ps JOIN pt_s p ON ps.asset = p.asset AND ps.metric = p.metric
  WHERE ps.metric IN ('delta_balanced_accuracy', 'delta_roc_auc') GROUP BY 1, 2"""}


@register("permutation_test", with_views(f"""
SELECT asset, metric, {round_cols(['actual_delta', 'perm_mean', 'perm_2_5', 'perm_97_5', 'share_ge_actual'])}, n_perm
FROM perm_summary""", "preds", extra=_PERM))
def permutation_test(spark, d):
    """2,000 date shuffles of the text model's predictions; share of deltas >= actual."""
    return resample.permutation_test(_pairs(spark, d), ["asset"], N_PERM, SEED)


@register("bh_adjust", with_views(f"""
SELECT asset, metric, {round_cols(['p_value', 'bonferroni', 'bh'])} FROM (
  SELECT asset, metric, p_value, least(CAST(1.0 AS DOUBLE), p_value * m) AS bonferroni,
         least(CAST(1.0 AS DOUBLE), min(raw) OVER (ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS bh
  FROM (SELECT *, p_value * m / i AS raw FROM (
          SELECT asset, metric, share_ge_actual AS p_value,
                 row_number() OVER (ORDER BY share_ge_actual, asset, metric) AS i, count(*) OVER () AS m
          FROM perm_summary) a) b) c""", "preds", extra=_PERM))
def bh_adjust(spark, d):
    """Bonferroni and Benjamini-Hochberg adjustment of the permutation p-values (all assets, metrics)."""
    p = resample.permutation_test(_pairs(spark, d), ["asset"], N_PERM, SEED)
    return resample.adjust_p(p.select("asset", "metric", F.col("share_ge_actual").alias("p_value")),
                             order=["asset", "metric"])
