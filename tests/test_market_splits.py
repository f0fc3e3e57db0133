"""Market features, targets and splits: group sizes, full-window gating, last-row rule, golden splits."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from textsignal.operators import market, prep, splits, targets


def _bars(spark, n=40, asset="A"):
    d0 = dt.date(2024, 1, 1)
    rows = [(asset, d0 + dt.timedelta(days=i), 10.0 + i, 11.0 + i, 9.0 + i, 10.5 + i + (i % 3), float(100 + i))
            for i in range(n)]
    df = spark.createDataFrame(rows, "asset string, date date, open double, high double, low double, "
                                     "close double, volume double")
    return df.withColumn("adj_close", F.col("close"))


def test_group_sizes(spark):
    df, man = market.market_full(_bars(spark))
    assert [len(man[g]) for g in ("prices_raw", "returns_rolling", "volume_rolling", "market_full")] == [11, 19, 10, 40]
    assert set(man["market_full"]).issubset(df.columns)


def test_rolling_needs_full_window(spark):
    df = market.add_returns_rolling(_bars(spark, 12)).orderBy("date").collect()
    # log_return_1 is NULL on row 0, so a 5-row mean needs rows 1..5 -> first value on row 5
    assert [r.rolling_mean_return_5 is None for r in df[:5]] == [True] * 5
    assert df[5].rolling_mean_return_5 is not None
    assert df[1].ma_2 is not None and df[0].ma_2 is None


def test_target_drops_last_row(spark):
    b = _bars(spark, 10)
    y = targets.direction_target(b, 1)
    assert y.count() == 9
    y3 = targets.multi_horizon_target(b, (1, 3, 7))
    assert {r.horizon: r["count"] for r in y3.groupBy("horizon").count().collect()} == {1: 9, 3: 7, 7: 3}


def test_partition_by_asset(spark):
    b = _bars(spark, 10, "A").unionByName(_bars(spark, 10, "B").withColumn("close", F.col("close") * 100))
    r = market.add_returns_rolling(b).where("asset = 'B'").orderBy("date").collect()
    assert r[0].log_return_1 is None  # no mixing of series (T17)


def _dates(spark, n):
    d0 = dt.date(2020, 1, 1)
    return spark.createDataFrame([(d0 + dt.timedelta(days=i),) for i in range(n)], "date date")


def test_split_rules_golden(spark):
    c2 = splits.date_splits(_dates(spark, 117), rule="floor_cumulative").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in c2} == {"train": 81, "validation": 18, "test": 18}
    c1 = splits.date_splits(_dates(spark, 163), rule="floor_each").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in c1} == {"train": 114, "validation": 24, "test": 25}


def test_split_too_few_dates_fails(spark):
    with pytest.raises(Exception):
        splits.date_splits(_dates(spark, 4)).collect()


def test_date_split_has_no_overlap_row_split_does(spark):
    d0 = dt.date(2020, 1, 1)
    # 42 rows, 2 per date: the 70 % row boundary (row 29) falls inside a date
    rows = [(a, d0 + dt.timedelta(days=i)) for i in range(21) for a in ("x", "y")]
    df = spark.createDataFrame(rows, "asset string, date date")
    assert splits.split_overlap(splits.split_by_date(df)).count() == 0
    assert splits.split_overlap(splits.row_splits(df, ["date", "asset"])).count() > 0


def test_row_balanced_split(spark):
    d0 = dt.date(2020, 1, 1)
    rows = [(d0 + dt.timedelta(days=i),) for i in range(10) for _ in range(i + 1)]
    out = {r.date: r.split for r in splits.row_balanced_splits(spark.createDataFrame(rows, "date date")).collect()}
    n = len(rows)
    before = 0
    for i in range(10):
        d = d0 + dt.timedelta(days=i)
        exp = "train" if before < int(0.7 * n) else "validation" if before < int(0.85 * n) else "test"
        assert out[d] == exp
        before += i + 1


@pytest.mark.parametrize("few", [True, False])
def test_exact_quantile_matches_numpy(spark, few):
    import numpy as np
    rng = np.random.default_rng(3)
    vals = rng.normal(size=3001).round(3)
    df = spark.createDataFrame([(float(v), "f") for v in vals], "x double, feature string")
    q = prep.exact_quantile(df, ["feature"], 0.5, few=few).first()
    assert q.quantile == pytest.approx(float(np.median(vals)))


def test_fit_stats_population_std_and_constant(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, "a"), (None, "a"), (5.0, "c"), (5.0, "c")], "x double, feature string")
    st = {r.feature: r for r in prep.fit_stats(df).collect()}
    assert st["a"].median == 2.0
    assert st["a"].std == pytest.approx((2 / 3) ** 0.5)  # [1, 3, 2] after imputation
    assert st["c"].scale == 1.0
