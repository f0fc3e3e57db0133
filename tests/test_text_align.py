"""Text parsing, tagging, scoring and no-look-ahead alignment."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from textsignal.operators import align, resample, text
from textsignal.plans import fixtures as fx


def test_word_boundary_accented_letters(spark):
    df = spark.createDataFrame([("ethé is here",), ("eth, rises",), ("ether",)], "t string")
    r = [x.a for x in df.select(text.tag_assets(F.col("t"), {"ETH": ["eth"]}).alias("a")).collect()]
    assert r == [[], ["ETH"], []]


def test_dated_lines_with_cashtag(spark):
    block = "2024-01-02: $aapl up\nnoise\n2024-01-03:down $AAPL\n2024-01-04: other"
    df = spark.createDataFrame([(block,)], "t string")
    out = text.dated_lines(df, "t", "$aapl").orderBy("line_no").collect()
    assert [(r.text_date, r.text) for r in out] == [(dt.date(2024, 1, 2), "$aapl up"), (dt.date(2024, 1, 3), "down $AAPL")]


def test_parse_record_state_rule(spark):
    rec = "\n".join([
        "date,open,close",                 # bare header, used only when no context line
        "2024-01-01,1,2",
        "context: date, open , close",     # context always resets the header
        "2024-01-02,3,4",
        "2024-01-05,9,9",                  # after decision date -> invalid
        "2024-01-03,x,4",                  # non-numeric -> invalid
        "2024-01-02: first text",
        "2024-01-04,5,6",                  # after the first text line -> not a table row
        "2024-01-03: second text",
    ])
    df = spark.createDataFrame([(rec, dt.date(2024, 1, 4))], "text string, decision_date date")
    p = text.valid_rows(text.parse_records(df), "decision_date", 10).first()
    assert p.header == ["date", "open", "close"]
    assert len(p.table_lines) == 4
    assert [t.date for t in p.texts] == ["2024-01-02", "2024-01-03"]
    assert [(r.date, r.nums) for r in p.rows] == [(dt.date(2024, 1, 1), [1.0, 2.0]), (dt.date(2024, 1, 2), [3.0, 4.0])]
    assert p.n_numeric == 2


def test_lexicon_scores_whole_text(spark):
    df = spark.createDataFrame([("and for was",), ("",), ("Worthless, worthless and",)], "t string")
    r = df.select(text.lexicon_scores(F.col("t"), fx.SENTIMENT_LEXICON).alias("s")).collect()
    assert r[0].s.p_pos == pytest.approx(2 / 3) and r[0].s.label == "positive"
    assert r[1].s.score == 0.0 and r[1].s.label == "neutral"
    assert r[2].s.p_neg == pytest.approx(2 / 3) and r[2].s.label == "negative"


def test_text_window_two_level_mean(spark):
    d = dt.date(2024, 1, 10)
    daily = spark.createDataFrame([("A", d - dt.timedelta(days=1), 1.0, 3), ("A", d - dt.timedelta(days=5), 0.0, 1),
                                   ("A", d, 9.0, 7), ("A", d - dt.timedelta(days=11), 5.0, 2)],
                                  "asset string, date date, mean_score double, text_count long")
    bars = spark.createDataFrame([("A", d), ("A", d + dt.timedelta(days=30))], "asset string, date date")
    r = {x.date: x for x in align.text_window(bars, daily, 10, 1).collect()}
    assert r[d].window_text_count == 4 and r[d].window_days == 2
    assert r[d].window_mean_score == pytest.approx(0.5)   # mean of daily means, same-day text excluded
    assert r[d + dt.timedelta(days=30)].window_has_text == 0


def test_next_day_join_shifts_one_calendar_day(spark):
    d = dt.date(2024, 1, 5)
    daily = spark.createDataFrame([("A", d, 2)], "asset string, date date, n long")
    bars = spark.createDataFrame([("A", d), ("A", d + dt.timedelta(days=1))], "asset string, date date")
    r = {x.date: x.n for x in align.join_next_day(bars, daily).collect()}
    assert r == {d: 0, d + dt.timedelta(days=1): 2}


def test_sequence_window_left_padded(spark):
    d0 = dt.date(2024, 1, 1)
    b = spark.createDataFrame([("A", d0 + dt.timedelta(days=i), float(i)) for i in range(3)],
                              "asset string, date date, close double")
    s = align.sequence_window(b, ["close"], 5).orderBy("date").collect()[-1].sequence
    assert [x.close for x in s] == [0.0, 0.0, 0.0, 1.0, 2.0]
    assert s[0].step_date is None


def test_bootstrap_and_permutation_are_deterministic(spark):
    d0 = dt.date(2024, 1, 1)
    rows = []
    for i in range(40):
        y = i % 2
        rows += [("market_full", "A", d0 + dt.timedelta(days=i), y, (i * 37 % 100) / 100.0),
                 ("text", "A", d0 + dt.timedelta(days=i), y, min(1.0, (i * 53 % 100) / 100.0 + 0.3 * y))]
    p = spark.createDataFrame(rows, "model string, asset string, date date, y_true int, y_proba double")
    pairs = resample.paired_table(p, "market_full", "text")
    a = {r.metric: r for r in resample.paired_bootstrap(pairs, n_boot=200).collect()}
    b = {r.metric: r for r in resample.paired_bootstrap(pairs.repartition(5), n_boot=200).collect()}
    assert a["delta_roc_auc"].ci_2_5 == b["delta_roc_auc"].ci_2_5
    assert a["delta_roc_auc"].n_boot == 200
    perm = {r.metric: r for r in resample.permutation_test(pairs, n_perm=100).collect()}
    assert 0.0 <= perm["delta_roc_auc"].share_ge_actual <= 1.0
    adj = resample.adjust_p(spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.5,)], "p_value double")).collect()
    bh = {r.p_value: r.bh for r in adj}
    assert bh[0.01] == pytest.approx(0.04) and bh[0.03] == pytest.approx(0.0533333, rel=1e-4)
    assert bh[0.5] == pytest.approx(0.5)


def test_records_over_lines_equal_records_in_rows(spark):
    import random
    from pyspark.sql import functions as F
    r = random.Random(11)
    kinds = ["context: date, a ,b", "Context:date,x", "date,p,q", "2024-01-02,1,2", "2024-01-03,1", "2024-01-03, 5 ,6 ", "2024-01-09,7,8", "bad-row,1,2",
             "2024-13-01,1,2", "2024-01-01,x,2", "2024-01-02: text one", "2024-01-03:  other", "2024-01-03:no space", "", "  ", "free words", "2024-01-04,nan,1"]
    rows = [(i, "\n".join(r.choice(kinds) for _ in range(r.randint(0, 9))), dt.date(2024, 1, 5)) for i in range(150)]
    rows += [(150, None, dt.date(2024, 1, 5)), (151, "2024-01-02,1,2\n" * 14, dt.date(2024, 1, 5)), (152, "date,a\n" + "2024-01-02: t\n" * 3000 + "2024-01-01,1", dt.date(2024, 1, 5))]
    df = spark.createDataFrame(rows, "id int, text string, decision_date date")
    want = text.valid_rows(text.parse_records(df), "decision_date", 10)
    lines = text.record_lines(df, "text", ["id", "decision_date"])
    records, table = text.parse_lines(lines.drop("decision_date"), ["id"])
    got = text.valid_row_lines(table.join(df.select("id", "decision_date"), "id"), ["id"], "decision_date", 10)
    flat = want.select("id", F.posexplode("rows").alias("step", "r")).select("id", "step", "r.date", "r.nums")
    assert sorted(str(tuple(x)) for x in flat.collect()) == sorted(str(tuple(x)) for x in got.select("id", "step", "row_date", "nums").collect())
    heads = {x.id: x.header for x in records.collect()}
    n_rows = {x.id: x["count"] for x in table.groupBy("id").count().collect()}
    dated = {}
    for x in text.text_lines(lines, ["id"]).collect():
        dated.setdefault(x.id, []).append((x.pos, x.text_date, x.text))
    for x in want.collect():
        assert (x.header or []) == heads.get(x.id, []) and len(x.table_lines or []) == n_rows.get(x.id, 0)
        assert [(t.date, t.text) for t in x.texts or []] == [t[1:] for t in sorted(dated.get(x.id, []))]
