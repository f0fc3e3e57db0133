"""Chronological splits and leak audits.

A split is decided on the *distinct dates* (a small table: one row per day),
then attached to the fact rows by an equi-join on ``date`` — a date can never
land in two splits.  Windows without a partition key run only over that date
table (bounded by the number of calendar days, not by rows).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textsignal.operators.prefix import running_before


def _ranked_dates(df: DataFrame, date: str, by: Sequence[str] = ()) -> DataFrame:
    d = df.select(*by, date).where(F.col(date).isNotNull()).distinct()
    w = Window.partitionBy(*by).orderBy(date)
    return d.select(*by, date, F.row_number().over(w).cast("long").alias("date_rank"),
                    F.count(F.lit(1)).over(Window.partitionBy(*by)).alias("n_dates"))


def date_splits(df: DataFrame, date: str = "date", train: float = 0.70, val: float = 0.15,
                rule: str = "floor_each", by: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """C1 (``floor_each``) / C2 (``floor_cumulative``): one row per distinct date (of every key ``by``) with its split.

    floor_each:       n_train = max(1, floor(n*train)), n_val = max(1, floor(n*val)); if nothing is
                      left for test: n_train = max(1, n-2), n_val = 1; fails when n < 5, or, if not
                      ``strict``, gives such a key no split (NULL).
    floor_cumulative: train_end = int(n*train), val_end = int(n*(train+val)).
    """
    d = _ranked_dates(df, date, by)
    n = F.col("n_dates")
    none = None
    if rule == "floor_each":
        nt = F.greatest(F.lit(1), F.floor(n.cast("double") * F.lit(train)))
        nv = F.greatest(F.lit(1), F.floor(n.cast("double") * F.lit(val)))
        full = nt + nv >= n
        n_train = F.when(full, F.greatest(F.lit(1), n - 2)).otherwise(nt)
        n_val = F.when(full, F.lit(1)).otherwise(nv)
        train_end, val_end = n_train, n_train + n_val
        guard = F.when((n < 5) & F.lit(strict), F.raise_error(F.lit("too few unique dates for a chronological split")))
        none = n < 5
    elif rule == "floor_cumulative":
        train_end = F.floor(n.cast("double") * F.lit(train))
        val_end = F.floor(n.cast("double") * F.lit(round(train + val, 10)))
        guard = F.lit(None)
    else:
        raise ValueError(f"unknown rule {rule!r}")
    r = F.col("date_rank")
    split = (F.when(r <= train_end, "train").when(r <= val_end, "validation").otherwise("test"))
    if none is not None:
        split = F.when(~none, split)
    return d.select(*by, date, "date_rank", F.coalesce(guard.cast("string"), split).alias("split"))


def split_by_date(df: DataFrame, date: str = "date", **kw) -> DataFrame:
    """Attach the date split to every row (J10).  The date table has one row per calendar day, so it is
    broadcast and no fact row moves."""
    return df.join(F.broadcast(date_splits(df, date, **kw).select(date, "split")), date)


def split_by_date_within(df: DataFrame, by: Sequence[str], date: str = "date", **kw) -> DataFrame:
    """The date split of every key ``by`` on its own dates.  The table of dates grows with the keys, so the join is left to
    measured sizes."""
    return df.join(date_splits(df, date, by=by, strict=False, **kw).drop("date_rank"), [*by, date])


def row_balanced_splits(df: DataFrame, date: str = "date", train: float = 0.70, val: float = 0.15) -> DataFrame:
    """C4 + W14: a date goes to train if the rows *before* it are < int(train*N), to validation if
    < int((train+val)*N), else test.  Per-date counts are a partial aggregate; the running
    sum runs on the date table only."""
    per_date = df.where(F.col(date).isNotNull()).groupBy(date).agg(F.count(F.lit(1)).alias("n_rows"))
    w = Window.orderBy(date)
    before = F.coalesce(F.sum("n_rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n_rows").over(Window.partitionBy())
    t = per_date.select(date, "n_rows", before.alias("rows_before"), total.alias("n_total"))
    ntr = F.floor(F.col("n_total").cast("double") * F.lit(train))
    nva = F.floor(F.col("n_total").cast("double") * F.lit(round(train + val, 10)))
    return t.select(date, "n_rows", "rows_before",
                    F.when(F.col("rows_before") < ntr, "train")
                    .when(F.col("rows_before") < nva, "validation").otherwise("test").alias("split"))


def row_splits(df: DataFrame, order: list[str], train: float = 0.70, val: float = 0.15, ranges: int | None = None) -> DataFrame:
    """C3 (legacy): first 70 % / next 15 % of rows in ``order`` (first key = the date); dates can
    leak across splits — kept only as the negative case of the leak audit.

    The global row number is rebuilt without a global sort: rows before each date come from a
    running sum over the per-date counts (the small date table), plus the rank inside the date, a
    two-level prefix sum over ranges, so that no task holds a whole date."""
    date = order[0]
    per = df.groupBy(date).agg(F.count(F.lit(1)).alias("_nd"))
    wd = Window.orderBy(date)
    per = per.select(F.col(date).alias("_d"), F.coalesce(F.sum("_nd").over(wd.rowsBetween(Window.unboundedPreceding, -1)),
                                                         F.lit(0)).alias("_before"),
                     F.sum("_nd").over(Window.partitionBy()).alias("_n"))
    x = running_before(df, [date], order[1:] or [date], name="_inside", ranges=ranges)
    x = x.join(F.broadcast(per), F.col(date).eqNullSafe(F.col("_d")))
    n, r = F.col("_n"), F.col("_before") + F.col("_inside") + 1
    return x.select(*df.columns, F.when(r <= F.floor(n * F.lit(train)), "train")
                    .when(r <= F.floor(n * F.lit(round(train + val, 10))), "validation")
                    .otherwise("test").alias("split"))


def tail_split(df: DataFrame, n: int = 30, asset: str = "asset", date: str = "date") -> DataFrame:
    """The last n rows of every asset are test."""
    w = Window.partitionBy(asset).orderBy(F.col(date).desc())
    return df.withColumn("split", F.when(F.row_number().over(w) <= n, "test").otherwise("train"))


def walk_forward_folds(df: DataFrame, date: str = "date", min_train: int = 60, test_size: int = 30,
                       step: int = 30) -> DataFrame:
    """Expanding-window folds on the date index.

    Fold k trains on dates ranked ``[1, t_k]`` and tests on ``(t_k, t_k + test_size]`` with
    ``t_k = min_train + k*step``.  Returns ``(fold, date, split)`` rows built from the
    distinct-date table with a generator (no join of folds x dates).
    """
    d = _ranked_dates(df, date)
    n_folds = F.floor((F.col("n_dates") - F.lit(min_train) - 1) / F.lit(step)) + 1
    # each date belongs to train of every fold whose cut >= rank, and to test of at most
    # ceil(test_size/step) folds; enumerate the folds that touch the date.
    folds = F.when(n_folds > 0, F.sequence(F.lit(0), (n_folds - 1).cast("int"))).otherwise(
        F.array().cast("array<int>"))
    x = d.select(date, "date_rank", F.explode(folds).alias("fold")).withColumn("fold", F.col("fold").cast("long"))
    cut = F.lit(min_train) + F.col("fold") * F.lit(step)
    r = F.col("date_rank")
    return (x.select(date, "fold", F.when(r <= cut, "train")
                     .when(r <= cut + F.lit(test_size), "test").alias("split"))
            .where(F.col("split").isNotNull()))


def split_summary(df: DataFrame, y: str = "y", date: str = "date", split: str = "split") -> DataFrame:
    """Rows, distinct dates, date range and positive share per split plus an ``all`` total
    in the same job (rollup)."""
    g = (df.rollup(split)
         .agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(date).alias("n_dates"),
              F.min(date).alias("date_min"), F.max(date).alias("date_max"),
              F.sum(y).alias("n_positive"), F.avg(F.col(y).cast("double")).alias("positive_share")))
    return g.select(F.coalesce(F.col(split), F.lit("all")).alias(split), "n_rows", "n_dates",
                    "date_min", "date_max", "n_positive", "positive_share")


def split_overlap(df: DataFrame, date: str = "date", split: str = "split") -> DataFrame:
    """Dates that appear in more than one split (must be empty)."""
    return (df.groupBy(date).agg(F.countDistinct(split).alias("n_splits"))
            .where(F.col("n_splits") > 1))


def leak_checklist(rows: DataFrame, feature_dates: DataFrame | None = None, date: str = "date",
                   split: str = "split", target_date: str | None = None) -> DataFrame:
    """One row per rule with its violation count.

    rules: ``dates_disjoint`` (a date in >1 split), ``target_uses_future`` (target date
    not after the decision date), ``feature_after_decision`` (a feature date after the
    decision date), ``splits_chronological`` (a train date after a validation/test date).
    """
    over = split_overlap(rows, date, split).agg(F.count(F.lit(1)).alias("v")).select(
        F.lit("dates_disjoint").alias("rule"), "v")
    parts = [over]
    if target_date:
        parts.append(rows.agg(F.count_if(F.col(target_date) <= F.col(date)).alias("v"))
                     .select(F.lit("target_uses_future").alias("rule"), "v"))
    if feature_dates is not None:
        parts.append(feature_dates.agg(F.count_if(F.col("feature_date") > F.col(date)).alias("v"))
                     .select(F.lit("feature_after_decision").alias("rule"), "v"))
    is_train = F.col(split) == "train"
    chron = rows.agg(F.max(F.when(is_train, F.col(date))).alias("train_hi"),
                     F.min(F.when(~is_train, F.col(date))).alias("other_lo")).select(
        F.lit("splits_chronological").alias("rule"),
        F.when(F.col("train_hi") >= F.col("other_lo"), 1).otherwise(0).cast("long").alias("v"))
    parts.append(chron)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("rule", F.col("v").cast("long").alias("violations"),
                      (F.col("v") == 0).alias("ok"))


def split_audit(rows: DataFrame, target_date: str, asset: str = "asset", date: str = "date", split: str = "split") -> DataFrame:
    """One row per decision: (asset, decision_date, target_date, split, crosses), where ``crosses`` tells
    that the target's date lies in another split than the decision."""
    days = F.broadcast(rows.select(F.col(date).alias(target_date), F.col(split).alias("_target_split")).distinct())
    return rows.join(days, target_date, "left").select(
        asset, F.col(date).alias("decision_date"), target_date, split,
        F.coalesce(F.col("_target_split") != F.col(split), F.lit(False)).alias("crosses"))


def purge(rows: DataFrame, days: int, date: str = "date", split: str = "split") -> DataFrame:
    """Drop the train (validation) rows whose label may reach into validation (test): those at most
    ``days`` calendar days before its first date.  ``days=0`` keeps all rows."""
    if days <= 0:
        return rows
    first = {s: F.min(F.when(F.col(split) == s, F.col(date))) for s in ("validation", "test")}
    bounds = rows.agg(*[x.alias(s) for s, x in first.items()]).first()       # two dates
    late = F.lit(False)
    for own, following in (("train", "validation"), ("validation", "test")):
        if bounds[following] is not None:
            late = late | ((F.col(split) == own) & (F.date_add(date, days) >= F.lit(bounds[following])))
    return rows.where(~late)
