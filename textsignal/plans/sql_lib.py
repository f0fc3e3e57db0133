"""Reusable SQL fragments for the oracle twins (DuckDB dialect)."""

from __future__ import annotations


def W(part: str = "asset", order: str = "date", frame: str = "") -> str:
    return f"OVER (PARTITION BY {part} ORDER BY {order}{(' ' + frame) if frame else ''})"


def rows_frame(k: int) -> str:
    return f"ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW"


def safe_div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def safe_ln(x: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN ln({x}) END)"


def log_ratio(a: str, b: str) -> str:
    return safe_ln(safe_div(a, b))


def gated(fn: str, x: str, k: int, part: str = "asset", order: str = "date") -> str:
    w = W(part, order, rows_frame(k))
    return f"(CASE WHEN count({x}) {w} = {k} THEN {fn}({x}) {w} END)"


def ratio0(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), CAST(0 AS DOUBLE))"


def ba(tn="tn", fp="fp", fn="fn", tp="tp") -> str:
    pos, neg = f"({tp} + {fn})", f"({tn} + {fp})"
    r1 = f"(CAST({tp} AS DOUBLE) / {pos})"
    r0 = f"(CAST({tn} AS DOUBLE) / {neg})"
    return (f"(CASE WHEN {pos} > 0 AND {neg} > 0 THEN ({r1} + {r0}) / CAST(2.0 AS DOUBLE) "
            f"WHEN {pos} > 0 THEN {r1} WHEN {neg} > 0 THEN {r0} END)")


def confusion_sql(src: str, by: str, y: str = "y_true", pred: str = "y_pred", w: str | None = None) -> str:
    one = w if w else "1"
    zero = "CAST(0 AS DOUBLE)" if w else "0"

    def s(cond):
        agg = f"sum(CASE WHEN {cond} THEN {one} ELSE {zero} END)"
        return agg if w else f"CAST({agg} AS BIGINT)"
    return (f"SELECT {by}, {s(f'{y} = 0 AND {pred} = 0')} AS tn, {s(f'{y} = 0 AND {pred} = 1')} AS fp, "
            f"{s(f'{y} = 1 AND {pred} = 0')} AS fn, {s(f'{y} = 1 AND {pred} = 1')} AS tp "
            f"FROM {src} GROUP BY {by}")


def metric_exprs(p: str = "") -> list[tuple[str, str]]:
    return [("accuracy", ratio0(f"{p}tp + {p}tn", f"{p}tn + {p}fp + {p}fn + {p}tp")),
            ("balanced_accuracy", ba(p + "tn", p + "fp", p + "fn", p + "tp")),
            ("precision", ratio0(f"{p}tp", f"{p}tp + {p}fp")),
            ("recall", ratio0(f"{p}tp", f"{p}tp + {p}fn")),
            ("f1", ratio0(f"2 * {p}tp", f"2 * {p}tp + {p}fp + {p}fn"))]


def rnd(expr: str, digits: int = 6) -> str:
    sc = repr(float(10 ** digits))
    return f"(round(CAST({expr} AS DOUBLE) * {sc}) / {sc} + 0.0)"


def metrics_cols(p: str = "", names: tuple[str, ...] | None = None) -> str:
    return ", ".join(f"{rnd(e)} AS {n}" for n, e in metric_exprs(p) if names is None or n in names)


def auc_sql(src: str, by: str, y: str = "y_true", score: str = "y_proba", w: str | None = None) -> str:
    """Exact ROC-AUC per group (ties 1/2), NULL if a class is missing."""
    one = w if w else "CAST(1 AS DOUBLE)"
    byc = by
    return f"""SELECT {byc}, CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(c) / (sum(p) * sum(n)) END AS roc_auc
FROM (SELECT {byc}, p, n, p * (coalesce(sum(n) OVER (PARTITION BY {byc} ORDER BY s
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 0.5 * n) AS c
      FROM (SELECT {byc}, CAST({score} AS DOUBLE) AS s,
                   sum(CASE WHEN {y} = 1 THEN {one} ELSE CAST(0 AS DOUBLE) END) AS p,
                   sum(CASE WHEN {y} = 0 THEN {one} ELSE CAST(0 AS DOUBLE) END) AS n
            FROM {src} GROUP BY {byc}, CAST({score} AS DOUBLE)) d) c
GROUP BY {byc}"""


def round_cols(cols: list[str], digits: int = 6) -> str:
    sc = repr(float(10 ** digits))
    return ", ".join(f"(round(CAST({c} AS DOUBLE) * {sc}) / {sc} + 0.0) AS {c}" for c in cols)


def c1_sql(src: str, date: str = "date", train: float = 0.7, val: float = 0.15) -> str:
    """C1 split table (date, date_rank, split) over the distinct dates of ``src``."""
    return f"""
  SELECT {date}, date_rank,
         CASE WHEN date_rank <= n_train THEN 'train'
              WHEN date_rank <= n_train + n_val THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT *, CASE WHEN nt + nv >= n_dates THEN greatest(1, n_dates - 2) ELSE nt END AS n_train,
               CASE WHEN nt + nv >= n_dates THEN 1 ELSE nv END AS n_val
        FROM (SELECT *, greatest(1, floor(n_dates * CAST({train!r} AS DOUBLE))) AS nt,
                     greatest(1, floor(n_dates * CAST({val!r} AS DOUBLE))) AS nv
              FROM (SELECT {date}, row_number() OVER (ORDER BY {date}) AS date_rank, count(*) OVER () AS n_dates
                    FROM (SELECT DISTINCT {date} FROM {src}) d) d2) d3) d4"""
