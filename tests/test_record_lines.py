"""Instruction records as lines and the long bars: what is shuffled, numbered and read again (own rows)."""

import datetime as dt
from collections import defaultdict

import pytest

from textsignal.operators import models, prefix
from textsignal.plans import fixtures as fx
from textsignal.plans import q_models, q_text

TEXTS = [(1, "that was one line here\n\n  second with tab\t\nthird"), (2, "from these words are two lines\nmore"),
         (2, "from these words are two lines\nmore"), (2, "that text with\nanother body\n\nunder the same id"), (3, "nothing tagged in here"),
         (5461, "that late line was sent\nthis too"), (None, "that was without an id"), (4, None), (9, "short"), (10926, "this was two days on\nend")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("records"))
    rows = [(i, t, "web", "en") for i, t in TEXTS]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{d}/documents.parquet")
    ticks = [(e, dt.datetime(2024, 1, day, 3, 0, n), float(n)) for e in (*fx.NEWS_LEXICON, "other") for day in range(1, 20) for n in range(2)]
    ticks.append((None, dt.datetime(2024, 1, 2), 1.0))
    spark.createDataFrame(ticks, "event_type string, ts timestamp_ntz, value double").write.parquet(f"{d}/events.parquet")
    lines = [(k, 1, 1, n, 10.0 + (k * 7 + n) % 5, 100.0 + (k * 13) % 17, 0.1, 0.1, "AN"[k % 2], dt.datetime(1995, 1, 1) + dt.timedelta(days=k))
             for k in range(80) for n in range(2)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                                 "l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp_ntz").write.parquet(f"{d}/lineitem.parquet")
    return d


def test_lines_are_not_shuffled_to_their_records(spark, tables):
    """With any number of events the days of the records are broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")       # as where the events are many
    try:
        lines = fx.flare_lines(spark, tables)
        plan = lines._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _expected(spark, tables):
    """Per record: the number of its table lines, and its news lines in groups of equal (day, id, place)."""
    heads = {(r["asset"], r["date"]): r["text"].split("\n") for r in fx.flare_raw(spark, tables).collect()}
    groups = defaultdict(lambda: defaultdict(list))
    for r in fx.news_by_asset(spark, tables).collect():
        for n, raw in enumerate(r["text"].split("\n")):
            raw = raw.strip()
            for k in range(fx.FLARE_TEXT_DAYS if raw else 0):
                key = (r["asset"], r["event_date"] + dt.timedelta(days=k))
                groups[key][r["event_date"], r["doc_id"], n].append(f"${r['asset']} {raw}")
    return heads, groups


def test_dated_lines_number_counts_and_not_lines(spark, tables, monkeypatch):
    """lines are numbered as in the text block, and no line is written or dealt to ranges for it."""
    written = []
    keep = prefix.materialize
    monkeypatch.setattr(prefix, "materialize", lambda df: written.append(df.columns) or keep(df))
    found = defaultdict(list)
    for r in q_text.dated_lines(spark, tables).collect():
        found[r["asset"], r["date"]].append((r["line_no"], r["text_date"], r["text"]))
    assert not any("line" in columns for columns in written)
    heads, groups = _expected(spark, tables)
    assert found.keys() == {k for k in groups if k in heads} and len(found) > 5
    for key, rows in found.items():
        rows.sort()
        flat = [(g, x) for g in sorted(groups[key]) for x in groups[key][g]]
        first = len(heads[key]) - len(flat)
        assert [n for n, _, _ in rows] == list(range(first, len(heads[key])))
        at = 0
        for g in sorted(groups[key]):
            lines = groups[key][g]
            assert sorted(t for _, _, t in rows[at:at + len(lines)]) == sorted(lines)
            assert all(d == g[0] for _, d, _ in rows[at:at + len(lines)])
            at += len(lines)
    assert any(len(x) > 1 for g in groups.values() for x in g.values())         # an id that comes again


def test_fits_do_not_aggregate_the_ticks_again(spark, tables, monkeypatch):
    """what the fit passes over comes from the written bars, not from the line items."""
    seen = []
    monkeypatch.setattr(models, "window_mlp", lambda df, cols: seen.append(df) or df.selectExpr(
        "asset", "date", "y as y_true", "0.5D as y_proba", "1 as y_pred"))
    q_models.mlp_window(spark, tables)
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and seen[0].count() > 50
