"""Schema detectors (P1-P5) and scalar guards."""

import pytest
from pyspark.sql import functions as F

from textsignal.functions import columns as C
from textsignal.functions import schema as S


def test_detectors(spark):
    df = spark.createDataFrame([(1, "2024-01-01", 1.0, "x", 0.1, 0.2)],
                               " Ticker  int, Date string, Close double, news_title string, emb_0 double, emb_1 double")
    n = S.normalize_columns(df)
    assert n.columns == ["ticker", "date", "close", "news_title", "emb_0", "emb_1"]
    assert S.detect_column(n, S.DATE_CANDIDATES) == "date"
    assert S.detect_column(df, ["close"]) == "Close"          # case-insensitive fallback
    with pytest.raises(ValueError):
        S.detect_column(df, S.DATE_CANDIDATES, explicit="nope")
    assert S.candidate_columns(n, S.TEXT_HINTS) == ["news_title"]
    assert S.candidate_columns(n, S.ASSET_HINTS) == ["ticker"]
    assert S.embedding_columns(n) == ["emb_0", "emb_1"]        # < 8 prefix matches: returned as is
    wide = spark.createDataFrame([tuple(float(i) for i in range(40))], ", ".join(f"`{i}` double" for i in range(40)))
    assert S.embedding_columns(wide)[:3] == ["0", "1", "2"] and len(S.embedding_columns(wide)) == 40


def test_guards(spark):
    df = spark.createDataFrame([(1.0, 0.0), (float("inf"), 2.0), (float("nan"), 1.0), (-1.0, 3.0)], "a double, b double")
    r = df.select(C.safe_div("a", "b").alias("d"), C.safe_ln("a").alias("l"), C.finite_or_null("a").alias("f")).collect()
    assert r[0].d is None and r[0].l == 0.0
    assert r[1].f is None and r[2].f is None and r[3].l is None
    one = spark.createDataFrame([([1.0, 2.0, 3.0],)], "a array<double>")
    x = one.select(C.left_pad("a", 5, F.lit(0.0)).alias("p"), C.last_n("a", 2).alias("t"), C.l2_norm("a").alias("n"),
                   C.threshold_grid().alias("g")).first()
    assert x.p == [0.0, 0.0, 1.0, 2.0, 3.0] and x.t == [2.0, 3.0]
    assert x.n == pytest.approx(14 ** 0.5)
    assert len(x.g) == 91 and x.g[0] == pytest.approx(0.05) and x.g[-1] == pytest.approx(0.95)
    assert C.dedupe(["a", "b", "a"]) == ["a", "b"]
