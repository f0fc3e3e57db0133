"""Sources, detectors, scorers and models: cases that a wrong answer once slipped through."""

import datetime as dt
import os
import tempfile

import numpy as np
import pandas as pd
import pytest

from textsignal.functions import schema
from textsignal.operators import align, market, metrics, models, newton, prep, splits, targets, text
from textsignal.plans import fixtures as fx
from textsignal.sources import files


def folder():
    return tempfile.mkdtemp(prefix="ts-fix-", dir="/tmp")


def test_csv_encoding_is_decided_on_all_bytes(spark):
    root = folder()
    late = os.path.join(root, "late.csv")
    with open(late, "wb") as f:
        f.write(b"a,b\n" + b"1,x\n" * 1600 + "2,caf\xe9\n".encode("latin-1"))
    rows = files.read_csv(spark, late, "a int, b string").collect()
    assert len(rows) == 1601 and rows[-1].b == "caf\xe9"
    with pytest.raises(ValueError):
        files.read_csv(spark, late, encodings=("UTF-8",))


def test_pretty_printed_json_keeps_all_rows(spark):
    root = folder()
    path = os.path.join(root, "p.json")
    with open(path, "w") as f:
        f.write('[\n {"a": 1,\n  "b": "x"},\n {"a": 2,\n  "b": "y"}\n]\n')
    assert sorted(r.a for r in files.read_json(spark, path).collect()) == [1, 2]
    assert sorted(r.a for r in files.read_json(spark, path, "a int, b string").collect()) == [1, 2]
    lines = os.path.join(root, "l.jsonl")
    with open(lines, "w") as f:
        f.write('{"a": 1}\n\n{"a": 2}\n')
    assert files.read_json(spark, lines).count() == 2
    bad = os.path.join(root, "bad.json")
    with open(bad, "w") as f:
        f.write('{"a": 1}\n{"a": \n')
    with pytest.raises(ValueError):
        files.read_json(spark, bad)


def test_a_corrupt_split_is_an_error_and_a_missing_one_is_not(spark):
    root = folder()
    spark.range(3).write.parquet(os.path.join(root, "train.parquet"))
    with open(os.path.join(root, "test.parquet"), "w") as f:
        f.write("not parquet")
    paths = {"train": os.path.join(root, "train.parquet"), "missing": os.path.join(root, "no.parquet")}
    assert files.read_splits(spark, paths).count() == 3
    with pytest.raises(Exception):
        files.read_splits(spark, paths | {"test": os.path.join(root, "test.parquet")}).count()


def test_only_the_failing_text_scores_zero(spark):
    def factory():
        def score(s):
            if s.str.contains("bad").any():
                raise RuntimeError("no")
            return pd.DataFrame({"p_pos": [0.7] * len(s), "p_neg": [0.1] * len(s), "p_neu": [0.2] * len(s)})
        return score

    d = dt.date(2024, 1, 2)
    df = spark.createDataFrame([("A", d, "good"), ("A", d, "bad one"), ("A", d, "fine"), ("A", d, " ")],
                               "asset string, event_date date, text string").coalesce(1)
    out = text.score_text(df, "text", scorer=factory)
    got = {r.text: (round(r.sentiment.score, 6), r.scorer_failed) for r in out.collect()}
    assert got == {"good": (0.6, False), "bad one": (0.0, True), "fine": (0.6, False), " ": (0.0, False)}
    assert align.daily_sentiment(out).first().n_texts == 4
    native = text.score_text(df, "text", lexicon=fx.SENTIMENT_LEXICON)
    assert native.schema["sentiment"].dataType.names == out.schema["sentiment"].dataType.names
    with pytest.raises(ValueError):
        text.score_text(df, "text")


def test_wide_header_keeps_all_columns(spark):
    n = 60
    rec = "context: date," + ",".join(f"c{i}" for i in range(n)) + "\n2024-01-01," + ",".join("1" for _ in range(n))
    df = spark.createDataFrame([(rec, dt.date(2024, 1, 4))], "text string, decision_date date")
    r = text.valid_rows(text.parse_records(df), "decision_date", 10).first()
    assert r.n_numeric == n and len(r.rows[0].nums) == n


def test_detectors(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Timestamp int, DATE int, Date int")
    assert schema.detect_column(df, schema.DATE_CANDIDATES) == "Date"
    swapped = spark.createDataFrame([(1, 2)], "Date int, DATE int")
    assert schema.detect_column(swapped, schema.DATE_CANDIDATES) == "DATE"      # the last of equal lower-case names
    assert schema.detect_column(swapped, ["Date"]) == "Date"
    assert schema.detect_column(df, ["Date"]) == "Date"
    assert schema.detect_column(df, ["close"]) is None
    assert schema.detect_column(df, ["close"], "Date") == "Date"
    with pytest.raises(ValueError):
        schema.detect_column(df, [], "absent")
    few = spark.createDataFrame([tuple(range(36))], [f"emb_{i}" for i in range(4)] + [str(i) for i in range(31, -1, -1)])
    assert schema.embedding_columns(few) == [str(i) for i in range(32)]
    assert schema.embedding_columns(few.select(*[f"emb_{i}" for i in range(4)])) == [f"emb_{i}" for i in range(4)]


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0] * 1000 + [6.0], [float(i % 7) for i in range(999)], list(np.linspace(-4, 9, 25_000))])
def test_exact_quantile(spark, values):
    df = spark.createDataFrame([("f", float(v)) for v in values] + [("f", None)], "feature string, x double")
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        got = prep.exact_quantile(df, ["feature"], q).first()
        assert got.n == len(values) and got.quantile == pytest.approx(np.quantile(values, q))


def test_auc_and_confusion_drop_null_scores(spark):
    df = spark.createDataFrame([("g", 1, 0.9), ("g", 0, 0.1), ("g", 1, None), ("g", 0, 0.95)], "g string, y_true int, y_proba double")
    assert metrics.roc_auc(df, ["g"]).first().roc_auc == pytest.approx(0.5)


def test_forecast_equals_least_squares(spark):
    r = np.random.default_rng(0)
    level = np.cumsum(r.standard_normal(120)) + 50
    rows = [("A", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(v), float(i % 5)) for i, v in enumerate(level)]
    df = spark.createDataFrame(rows, "asset string, date date, close double, x double")
    got = {p.k: p for p in models.direct_forecast(df, 5, exog="x").collect()}
    d = np.concatenate([[np.nan], np.diff(level)])
    for k in range(1, 6):
        use = [t for t in range(8, 120 - 5 - k)]
        a = np.array([[1, d[t], d[t - 1], d[t - 7], t % 5] for t in use])
        beta = np.linalg.lstsq(a, np.array([d[t + k] for t in use]), rcond=None)[0]
        t = 114
        assert got[k].pred == pytest.approx(float(np.array([1, d[t], d[t - 1], d[t - 7], t % 5]) @ beta))
        assert got[k].n_train == len(use) and got[k].level_naive == pytest.approx(level[114])


def test_pca_projection(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((60, 6)) @ r.standard_normal((6, 6)) + 3
    rows = [(i, "train" if i < 45 else "test", [float(v) for v in x[i]]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, split string, v array<double>")
    out, explained, k = models.pca_embeddings(df, "v", 3)
    p = np.array([q.pca for q in out.where("split = 'train'").orderBy("id").collect()])
    assert k == 3 and np.allclose(p.mean(axis=0), 0, atol=1e-9)
    cross = p.T @ p / len(p)
    assert np.allclose(cross - np.diag(np.diag(cross)), 0, atol=1e-8)
    assert np.trace(cross) / 6 == pytest.approx(explained)


def test_logistic_regression_meets_its_gradient_condition(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((200, 2))
    y = (x[:, 0] + 0.5 * r.standard_normal(200) > 0).astype(int)
    rows = [("A", dt.date(2024, 1, 1) + dt.timedelta(days=i), ("train", "validation", "test")[0 if i < 140 else 1 if i < 170 else 2],
             float(x[i, 0]), float("inf") if i == 3 else float(x[i, 1]), int(y[i])) for i in range(200)]
    df = spark.createDataFrame(rows, "asset string, date date, split string, a double, b double, y int")
    test, sel = models.fit_logreg_group(df, ["a", "b"], "g", c_grid=(1.0,), threshold=0.5)
    got = np.array([t.y_proba for t in test.orderBy("date").collect()])
    z = np.array([[q[3], q[4] if np.isfinite(q[4]) else np.nan] for q in rows])
    train = z[:140]
    z = np.where(np.isnan(z), np.nanmedian(train, axis=0), z)
    z = (z - z[:140].mean(axis=0)) / z[:140].std(axis=0)
    w = np.where(y[:140] == 1, 140 / (2 * y[:140].sum()), 140 / (2 * (140 - y[:140].sum())))
    # Newton steps on the weighted objective: sum(w * loss) / sum(w) + |beta|^2 / (2 n)
    a, beta = np.column_stack([z[:140], np.ones(140)]), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ beta))
        g = a.T @ (w * (p - y[:140])) / w.sum() + np.append(beta[:2], 0) / 140
        h = (a * (w * p * (1 - p))[:, None]).T @ a / w.sum() + np.diag([1 / 140, 1 / 140, 0])
        beta -= np.linalg.solve(h, g)
    want = 1 / (1 + np.exp(-(z[170:] @ beta[:2] + beta[2])))
    assert np.allclose(got, want, atol=2e-3)
    assert sel.first().n_features == 2


def test_ingest_targets_and_audits(spark):
    raw = spark.createDataFrame([(dt.datetime(2024, 1, 2, 16), 1.0, 2.0)], ["Datetime", "('Close', 'X')", " Adj Close"])
    assert market.ingest_bars(raw, "X").first().asDict() == {"date": dt.date(2024, 1, 2), "close": 1.0, "adj_close": 2.0, "asset": "X"}
    d = spark.createDataFrame([("2024-01-02", "1"), ("junk", "1"), ("2024-01-03", "x"), ("2024-01-04", None)], "date string, y string")
    assert [tuple(r) for r in targets.ensure_target(targets.coerce_dates(d, "date"), "y").collect()] == [(dt.date(2024, 1, 2), 1)]
    ties = spark.createDataFrame([("A", 1, 5, "b"), ("A", 1, 5, "a"), ("A", 2, 1, "z")], "k string, g int, o int, v string")
    assert {(r.g, r.v) for r in targets.first_per_key(ties, ["k", "g"], ["o"]).collect()} == {(1, "a"), (2, "z")}
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(10)]
    rows = spark.createDataFrame([("A", x, days[i + 1] if i < 9 else None, "train" if i < 6 else "validation" if i < 8 else "test")
                                  for i, x in enumerate(days)], "asset string, date date, target_date date, split string")
    assert [r.decision_date for r in splits.split_audit(rows, "target_date").where("crosses").orderBy("decision_date").collect()] == [days[5], days[7]]
    assert splits.purge(rows, 0).count() == 10
    assert [r.date for r in splits.purge(rows, 2).orderBy("date").collect()] == days[:4] + days[8:]


def test_embedding_store_grows_by_new_texts(spark):
    texts = spark.createDataFrame([("a",), ("b",), ("b",)], "text string")
    empty = spark.createDataFrame([], "text_hash string, embedding array<double>")
    embed = lambda d: text.hash_embed(d, "text_hash", "text", 8)
    store = text.update_store(texts, empty, embed)
    assert store.count() == 2
    again = text.update_store(texts.union(spark.createDataFrame([("c",)], "text string")), store, embed)
    assert again.count() == 3
    assert all(sum(x * x for x in r.embedding) == pytest.approx(1.0) for r in again.collect())


def test_day_chunks_join_to_the_day(spark):
    rows = [("A", i, "t%d " % i * (i % 5 + 1)) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, o int, text string")
    whole = text.same_day_text(df, ["k"], "o").first().day_text
    chunks = text.same_day_chunks(df, ["k"], "o", size=50).orderBy("chunk_no").collect()
    assert len(chunks) > 5 and " ".join(c.chunk_text for c in chunks) == whole


def test_every_query_has_a_twin_or_a_property_test():
    import __spark_entry__ as entry
    tested = {"logreg_ablation", "logreg_fixed_c", "training_curve", "pca_embeddings", "arx_forecast", "mlp_window", "rf_prices",
              "text_ablation", "predictions", "experiment_grid"}
    own = {q for q in entry.queries() if not q.startswith("op") and q != "pipeline"}
    assert own - set(entry.oracle_sql()) <= tested


def test_text_queries_run_the_whole_grid(spark, monkeypatch):
    from textsignal.plans import q_models
    r = np.random.default_rng(3)
    x, days = r.standard_normal((90, 3)), [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(90)]
    rows = [("A", d, "train" if i < 50 else "validation" if i < 70 else "test", int(a + r.standard_normal() > 0), [float(a), float(b), float(c)])
            for i, (d, (a, b, c)) in enumerate(zip(days, x))]
    frame = spark.createDataFrame(rows, "asset string, date date, split string, y int, features array<double>")
    groups = {"market_full": [0], "text_meta": [1, 2]}
    monkeypatch.setattr(q_models, "_text_groups", lambda s, d: (frame, groups))
    runs, whole, selected = [], newton.newton, []
    monkeypatch.setattr(newton, "newton", lambda t, c, design, dim, n: runs.append((design, n)) or whole(t, c, design, dim, n))
    both = q_models._text_predictions
    monkeypatch.setattr(q_models, "_text_predictions", lambda s, d: selected.append(both(s, d)) or selected[-1])
    rows = {r.feature_group: r for r in q_models.text_ablation(spark, None).collect()}
    monkeypatch.setattr(q_models, "_text_predictions", lambda s, d: selected[0])     # one training for both queries
    preds = q_models.predictions(spark, None).toPandas()
    fitted = [g for g, r in rows.items() if r.selected_C is not None]
    (design, max_iter), = runs
    assert design.c_grid == models.C_GRID == (0.01, 0.1, 1.0, 10.0) and max_iter >= 100 and design.names == list(groups)
    assert set(fitted) == set(groups) and {r.selected_C for r in rows.values()} - {None} <= set(models.C_GRID)
    assert {r.fit_status for r in selected[0][1].collect()} == {"converged"}
    assert set(preds["feature_group"]) == set(rows) >= {"majority", "previous_direction", "market_full"}
    assert not preds.duplicated(["asset", "date", "feature_group"]).any()
    assert preds[preds["feature_group"].isin(fitted)].groupby("feature_group").size().nunique() == 1
    for g, p in preds.groupby("feature_group"):
        r, y, hit = rows[g], p["y_true"] == 1, p["y_pred"] == 1
        assert (r.tp, r.fp, r.fn, r.tn) == ((y & hit).sum(), (~y & hit).sum(), (y & ~hit).sum(), (~y & ~hit).sum())
        if g in fitted:
            assert p["y_proba"].between(0, 1).all() and ((p["y_proba"] >= r.selected_threshold) == hit).all()
        assert r.delta_balanced_accuracy == pytest.approx(r.balanced_accuracy - rows["market_full"].balanced_accuracy, nan_ok=True)
