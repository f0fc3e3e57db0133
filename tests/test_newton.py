"""Grouped Newton steps: single fits, gradient conditions, loss curves, the grid of experiments and its log."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from textsignal.operators import metrics, models, newton
from textsignal.plans import q_extra
from textsignal.sources import files

DAY = dt.date(2024, 1, 1)


def sample(seed, n, dim, shift=0.0):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim)) * np.linspace(0.5, 3, dim) + 5
    y = ((x[:, 0] - 5) * 2 + 0.5 * (x[:, -1] - 5) + r.standard_normal(n) > shift).astype(int)
    x[3, 1 % dim], x[n - 2, 0] = np.nan, np.inf
    part = np.where(np.arange(n) < 0.7 * n, "train", np.where(np.arange(n) < 0.85 * n, "validation", "test"))
    return x, y, part


def rows_of(cell, x, y, part):
    return [(*cell, DAY + dt.timedelta(days=i), str(part[i]), int(y[i]), [None if np.isnan(v) else float(v) for v in x[i]]) for i in range(len(y))]


def plain_fit(x, y, part, at, c, penalise=False):
    """Newton steps of one fit: (probabilities of all rows, gradient of the objective, coefficients, objective per step)."""
    x = np.where(np.isfinite(x), x, np.nan)[:, at]
    train = part == "train"
    x = np.where(np.isnan(x), np.nanmedian(x[train], axis=0), x)
    z = (x - x[train].mean(axis=0)) / x[train].std(axis=0)
    a, t = np.column_stack([z, np.ones(len(z))]), y[train]
    n = train.sum()
    w = np.where(t == 1, n / (2 * t.sum()), n / (2 * (n - t.sum())))
    lam = np.append(np.ones(len(at)), float(penalise)) / (c * n)
    beta = np.zeros(len(at) + 1)

    def gradient(b):
        p = 1 / (1 + np.exp(-a[train] @ b))
        return a[train].T @ (w * (p - t)) / n + lam * b, p
    for _ in range(100):
        g, p = gradient(beta)
        beta = beta - np.linalg.solve((a[train] * (w * p * (1 - p))[:, None]).T @ a[train] / n + np.diag(lam), g)
    return 1 / (1 + np.exp(-a @ beta)), beta, z, w


SCHEMA = "source string, asset string, horizon int, date date, split string, y int, features array<double>"
GROUPS = {"narrow": [0], "all": [0, 1, 2, 3], "wide": list(range(30)), "none": []}


@pytest.fixture(scope="module")
def grid(spark):
    """Two good cells, one with a single class, one with too few dates, one without test rows."""
    good = [(("a", "x", 1), sample(1, 300, 30)), (("a", "y", 3), sample(2, 200, 30, 2.0))]
    rows = [r for cell, s in good for r in rows_of(cell, *s)]
    x, y, part = sample(3, 100, 30)
    rows += rows_of(("b", "x", 1), x, np.where(part == "train", 1, y), part)
    rows += rows_of(("b", None, 1), *[v[:20] for v in (x, y, part)])
    rows += rows_of(("b", "z", 7), x, y, np.where(part == "test", "train", part))
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    by = ["source", "asset", "horizon"]
    return newton.fit_grid(df, GROUPS, by=by, keys=[*by, "date"], min_dates=60), dict(good)


def test_cells_that_cannot_be_fitted_are_rows(grid):
    got = {(r.source, r.asset, r.horizon): r for r in grid[0].cells.collect()}
    assert {k: r.status for k, r in got.items()} == {("a", "x", 1): "ok", ("a", "y", 3): "ok", ("b", "x", 1): "one_class",
                                                     ("b", None, 1): "too_few_dates", ("b", "z", 7): "empty_split"}
    assert got["b", "x", 1].error == "train holds 0 falls and 70 rises" and got["b", None, 1].error == "20 of 60 dates"
    assert got["b", "z", 7].error == "85 train, 15 validation, 0 test rows" and got["a", "x", 1].error is None
    assert got["a", "x", 1].n_rows == 300 and got["a", "x", 1].n_dates == 300


def test_grid_equals_single_fits(grid):
    g, cells = grid
    preds = g.predictions().toPandas()
    chosen = {(r.source, r.asset, r.feature_group): r for r in g.selection.collect()}
    assert len(chosen) == 6
    for (source, asset, _), (x, y, part) in cells.items():
        for name, at in GROUPS.items():
            if not at:
                assert (source, asset, name) not in chosen
                continue
            r = chosen[source, asset, name]
            best = None
            for c in newton.C_GRID:
                p, *_ = plain_fit(x, y, part, at, c)
                v = part == "validation"
                for tau in newton.THRESHOLDS:
                    hit = p[v] >= tau
                    ba = (hit[y[v] == 1].mean() + (~hit)[y[v] == 0].mean()) / 2
                    if best is None or ba > best[0] + 1e-12:
                        best = ba, c, tau, p
            assert r.fit_status == "converged" and r.gradient < 1e-8 and r.n_features == len(at)
            assert (r.selected_C, r.selected_threshold) == pytest.approx(best[1:3]) and r.val_balanced_accuracy == pytest.approx(best[0])
            mine = preds[(preds.source == source) & (preds.asset == asset) & (preds.feature_group == name)].sort_values("date")
            assert np.allclose(mine.y_proba, best[3][part == "test"], atol=1e-7)
            assert (mine.y_true.to_numpy() == y[part == "test"]).all() and (mine.y_pred == (mine.y_proba >= best[2])).all()


def test_report_and_log(spark, grid, tmp_path):
    g, _ = grid
    report = q_extra.grid_report(g, base="all").collect()
    assert len(report) == 9 and {r.feature_group for r in report if r.status != "ok"} == {None}
    by = {(r.source, r.asset, r.feature_group): r for r in report}
    for (s, a, name), r in by.items():
        if name:
            assert r.delta_balanced_accuracy == pytest.approx(r.balanced_accuracy - by[s, a, "all"].balanced_accuracy) and r.tp + r.fp + r.fn + r.tn in (45, 30)
    log = files.run_log(g.cells, "/out").collect()
    assert len(log) == 5 and {r.out_dir for r in log} == {"/out/source=a/asset=x/horizon=1", "/out/source=a/asset=y/horizon=3", None}
    ev = metrics.evaluate(g.predictions(), [*g.by, "feature_group"])
    out = os.path.join(tmp_path, "grid")
    assert files.write_grid(g.cells, ev, out).count() == 5
    back = spark.read.parquet(out)
    assert back.count() == 6 and spark.read.option("header", True).csv(out + "_log").count() == 5
    assert {r.source for r in back.select("source").distinct().collect()} == {"a"}


def test_curves_are_recomputed_from_coefficients(grid):
    g, cells = grid
    curves = g.curves().toPandas()
    for (source, asset, _), (x, y, part) in cells.items():
        for name, at in (("narrow", [0]), ("wide", GROUPS["wide"])):
            mine = curves[(curves.source == source) & (curves.asset == asset) & (curves.feature_group == name) & (curves.C == 1.0)].sort_values("iteration")
            _, beta, z, w = plain_fit(x, y, part, at, 1.0)
            a = np.column_stack([z, np.ones(len(z))])
            assert mine.iteration.tolist() == list(range(len(mine))) and len(mine) > 3
            for r in mine.itertuples():
                b = np.asarray(r.beta)
                loss = np.logaddexp(0, a @ b) - y * (a @ b)
                assert r.train_loss == pytest.approx((w * loss[part == "train"]).mean(), rel=1e-9)
                assert r.val_loss == pytest.approx(loss[part == "validation"].mean(), rel=1e-9)
            assert np.asarray(mine.beta.iloc[0]).tolist() == [0.0] * (len(at) + 1) and np.allclose(mine.beta.iloc[-1], beta, atol=1e-7)
            assert (mine.objective.diff().dropna() <= 1e-12).all()
            assert mine.is_best.sum() == 1 and mine.val_loss[mine.is_best].iloc[0] == mine.val_loss.min()


def test_penalised_intercept(spark):
    x, y, part = sample(5, 250, 4, 3.0)
    df = spark.createDataFrame([r[1:2] + r[3:] for r in rows_of(("s", "a", 1), x, y, part)], "asset string, date date, split string, y int, features array<double>")
    df = df.select("*", *[F.col("features")[i].alias(f"c{i}") for i in range(4)])
    for penalise in (False, True):
        test, sel = models.fit_logreg_group(df, [f"c{i}" for i in range(4)], "g", c_grid=(0.05,), threshold=0.5, penalise_intercept=penalise)
        want, beta, *_ = plain_fit(x, y, part, [0, 1, 2, 3], 0.05, penalise)
        got = [r.y_proba for r in test.orderBy("date").collect()]
        assert np.allclose(got, want[part == "test"], atol=1e-7)
        assert sel.first().gradient < 1e-8 and sel.first().selected_threshold == 0.5
    with pytest.raises(ValueError):
        models.fit_logreg_group(df, ["c0"], "g", threshold=0.123456)


def test_separable_and_constant_features(spark):
    rows = [("a", DAY + dt.timedelta(days=i), "train" if i < 40 else "validation" if i < 50 else "test", i % 2, [float(i % 2), 7.0, None]) for i in range(60)]
    df = spark.createDataFrame(rows, "asset string, date date, split string, y int, features array<double>")
    g = newton.fit_grid(df, {"all": [0, 1, 2], "flat": [1], "empty": [2]}, c_grid=(0.1, 1e6))
    sel = {r.feature_group: r for r in g.selection.collect()}
    assert {r.fit_status for r in sel.values()} == {"converged"} and sel["all"].val_balanced_accuracy == 1.0
    assert all(r.y_pred == r.y_true for r in g.predictions().where("feature_group = 'all'").collect())
    assert {round(r.y_proba, 9) for r in g.predictions().where("feature_group <> 'all'").collect()} == {0.5}
    nothing = newton.fit_grid(df.limit(0), {"all": [0]})
    assert nothing.cells.count() == nothing.predictions().count() == nothing.curves().count() == 0


def test_forest_and_mlp_learn(spark):
    """Better than the majority on a separable frame, and the same on a second run."""
    r = np.random.default_rng(4)
    x = r.standard_normal((240, 3))
    y = (x[:, 0] + 0.2 * r.standard_normal(240) > 0.3).astype(int)
    rows = [("A", DAY + dt.timedelta(days=i), "train" if i < 160 else "test", int(y[i]), *map(float, x[i])) for i in range(240)]
    df = spark.createDataFrame(rows, "asset string, date date, split string, y int, a double, b double, c double").coalesce(1)
    base = max(y[160:].mean(), 1 - y[160:].mean())
    for fit in (models.window_mlp, models.random_forest):
        one, two = (fit(df, ["a", "b", "c"]).orderBy("date").collect() for _ in range(2))
        assert np.mean([p.y_pred == p.y_true for p in one]) > base + 0.15
        assert [p.y_proba for p in one] == [p.y_proba for p in two]
        assert all(0 <= p.y_proba <= 1 for p in one) and len(one) == 80


def test_stationary_series_are_forecast_in_levels(spark):
    r = np.random.default_rng(6)
    flat, walk = [0.0], np.cumsum(r.standard_normal(150)) + 50
    for _ in range(149):
        flat.append(0.2 * flat[-1] + r.standard_normal())
    series = {"flat": np.array(flat) + 10, "walk": walk}
    df = spark.createDataFrame([(a, DAY + dt.timedelta(days=i), float(v)) for a, s in series.items() for i, v in enumerate(s)],
                               "asset string, date date, close double")
    got = {(p.asset, p.k): p for p in models.direct_forecast(df, 5, by_test=True).collect()}
    for asset, level in series.items():
        s = level if asset == "flat" else np.concatenate([[np.nan], np.diff(level)])
        total = 0.0
        for k in range(1, 6):
            use = [t for t in range(7 if asset == "flat" else 8, 150 - 5 - k)]
            a = np.array([[1, s[t], s[t - 1], s[t - 7]] for t in use])
            beta = np.linalg.lstsq(a, np.array([s[t + k] for t in use]), rcond=None)[0]
            pred = float(np.array([1, s[144], s[143], s[137]]) @ beta)
            total += pred
            p = got[asset, k]
            assert p.differenced == (asset == "walk") and p.pred == pytest.approx(pred) and p.n_train == len(use)
            assert p.level_pred == pytest.approx(pred if asset == "flat" else level[144] + total)
            assert p.level_actual == pytest.approx(level[144 + k])
