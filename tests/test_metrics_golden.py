"""Golden vectors from the published confusion counts, AUC and threshold tie rules."""

import pytest
from pyspark.sql import functions as F

from textsignal.operators import metrics

GOLDEN = [  # tp, tn, fp, fn -> acc, ba, f1 (3 decimals)
    (66, 25, 79, 52, 0.410, 0.400, 0.502),
    (100, 22, 82, 18, 0.550, 0.529, 0.667),
    (80, 28, 76, 38, 0.486, 0.474, 0.584),
    (29, 67, 37, 89, 0.432, 0.445, 0.315),
    (118, 0, 104, 0, 0.532, 0.500, 0.694),
    (0, 7, 0, 11, 0.389, 0.500, 0.0),
    (5, 5, 2, 6, 0.556, 0.584, 0.556),
]


def _rows(tp, tn, fp, fn):
    return [(1, 1)] * tp + [(0, 0)] * tn + [(0, 1)] * fp + [(1, 0)] * fn


@pytest.mark.parametrize("tp,tn,fp,fn,acc,ba,f1", GOLDEN)
def test_confusion_metrics_golden(spark, tp, tn, fp, fn, acc, ba, f1):
    df = spark.createDataFrame(_rows(tp, tn, fp, fn), "y_true int, y_pred int").withColumn("g", F.lit("x"))
    r = metrics.classification_metrics(metrics.confusion(df, ["g"])).first()
    assert (r.tp, r.tn, r.fp, r.fn) == (tp, tn, fp, fn)
    assert round(r.accuracy, 3) == acc
    assert round(r.balanced_accuracy, 3) == ba
    assert round(r.f1, 3) == f1


def test_auc_constant_score_is_half_and_complement(spark):
    rows = [(i % 2, 0.3) for i in range(10)]
    df = spark.createDataFrame(rows, "y_true int, y_proba double").withColumn("g", F.lit(1))
    assert metrics.roc_auc(df, ["g"]).first().roc_auc == 0.5
    rows = [(1, 0.9), (1, 0.4), (0, 0.4), (0, 0.1), (1, 0.7), (0, 0.8)]
    df = spark.createDataFrame(rows, "y_true int, y_proba double").withColumn("g", F.lit(1))
    a = metrics.roc_auc(df, ["g"], n_buckets=4).first().roc_auc
    b = metrics.roc_auc(df.withColumn("y_proba", 1 - F.col("y_proba")), ["g"], n_buckets=1).first().roc_auc
    # brute force: pairs (pos, neg), ties 1/2
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert a == pytest.approx(brute)
    assert b == pytest.approx(1 - brute)


def test_auc_single_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.3)], "y_true int, y_proba double").withColumn("g", F.lit(1))
    assert metrics.roc_auc(df, ["g"]).first().roc_auc is None


def test_bucketed_auc_equals_plain_window(spark):
    import random
    rnd = random.Random(7)
    rows = [(rnd.randint(0, 1), round(rnd.random(), 2), rnd.randint(0, 2)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "y_true int, y_proba double, g int")
    a = {r.g: r.roc_auc for r in metrics.roc_auc(df, ["g"], n_buckets=1).collect()}
    b = {r.g: r.roc_auc for r in metrics.roc_auc(df, ["g"], n_buckets=37).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-12)


def test_threshold_tie_picks_lowest(spark):
    df = spark.createDataFrame([(i % 2, 0.5) for i in range(20)], "y_true int, y_proba double") \
        .withColumn("g", F.lit(1))
    r = metrics.tune_threshold(df, ["g"]).first()
    assert r.threshold == pytest.approx(0.05)
    assert r.val_balanced_accuracy == 0.5


def test_majority_tie_picks_zero(spark):
    df = spark.createDataFrame([(0, "train"), (1, "train"), (1, "test")], "y_true int, split string") \
        .withColumn("g", F.lit(1))
    assert metrics.majority_class(df.where("split = 'train'"), ["g"]).first().majority_class == 0


def test_date_weights_sum_to_dates(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "asset string, date int").withColumn("m", F.lit("x"))
    w = metrics.date_weights(df, ["m"])
    assert w.agg(F.sum("date_weight")).first()[0] == pytest.approx(2.0)
