"""Files (S2, S5, S8, S12, S13), the text store (S14), prefix sums (X13, C3), and rows without prices."""

import datetime as dt
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from textsignal.operators import align, market, prefix, profile, splits, targets, text
from textsignal.sources import files
from textsignal.sources.store import TextStore

DAY = dt.date(2024, 1, 1)


def write(root, name, data, encoding="utf-8"):
    os.makedirs(root, exist_ok=True)
    with open(os.path.join(root, name), "wb") as f:
        f.write(data.encode(encoding))
    return os.path.join(root, name)


def test_every_file_of_a_folder_has_its_encoding(spark, tmp_path):
    root = str(tmp_path / "in put")
    write(root, "a one.csv", "id,name,x\n1,café,1\n2,日本,2\n")
    write(root, "b.csv", "id,name,x\n3,café,2.5\n4,naïve,3\n", "latin-1")
    write(root, "c.csv", "id,name,x\n5,plain,6\n")
    df = files.read_csv(spark, root)
    got = {r.id: r for r in df.collect()}
    assert {k: r.name for k, r in got.items()} == {1: "café", 2: "日本", 3: "café", 4: "naïve", 5: "plain"}
    one = files.read_csv(spark, os.path.join(root, "b.csv"))
    assert [r.name for r in one.orderBy("id").collect()] == ["café", "naïve"]
    with pytest.raises(ValueError, match="b.csv"):
        files.read_csv(spark, root, encodings=("UTF-8",))
    declared = files.read_csv(spark, root, "id long, name string, x double")
    assert declared.count() == 5 and dict(declared.dtypes) == {"id": "bigint", "name": "string", "x": "double"}


def test_types_of_two_encodings_are_joined(spark, tmp_path):
    root = str(tmp_path / "d")
    write(root, "a.csv", "k,v,w\né,1,1\n")
    write(root, "b.csv", "k,v,w\né,1.5,word\n", "latin-1")
    df = files.read_csv(spark, root)
    assert dict(df.dtypes) == {"k": "string", "v": "double", "w": "string"}
    assert sorted((r.k, r.v, r.w) for r in df.collect()) == [("é", 1.0, "1"), ("é", 1.5, "word")]


def test_bad_records_are_error_rows(spark, tmp_path):
    root = str(tmp_path)
    a = write(root, "a.csv", "id,x\n1,2.5\n2,3.5,extra\n3,4.5\n")
    b = write(root, "b.jsonl", '{"id": 1, "x": 2}\n{"id": 2, "x"\n{"id": 3, "x": 4}\n')
    c, d = write(root, "c.json", "no json\nat all\n"), write(root, "d.csv", "id\n7\n")
    ok, errors = files.read_many(spark, [a, b, c, d, os.path.join(root, "absent.parquet")])
    assert sorted((r.id, r.x) for r in ok[a].collect()) == [(1, 2.5), (3, 4.5)]
    assert sorted((r.id, r.x) for r in ok[b].collect()) == [(1, 2), (3, 4)]
    assert [r.id for r in ok[d].collect()] == [7] and set(ok) == {a, b, d}
    rows = {os.path.basename(r.file): r for r in errors.collect()}
    assert set(rows) == {"a.csv", "b.jsonl", "c.json", "absent.parquet"} and errors.count() == 4
    assert rows["a.csv"].record == "2,3.5,extra" and rows["b.jsonl"].record == '{"id": 2, "x"'
    assert "malformed" in rows["a.csv"].error and "neither JSON" in rows["c.json"].error and rows["c.json"].record is None
    good, bad = files.read_records(spark, a, "csv", "id int, x int")
    assert good.count() == 0 and bad.count() == 3                    # values that don't fit the declared types


def test_preview_and_sinks(spark, tmp_path):
    p = write(str(tmp_path), "a.csv", "id,x\n" + "".join(f"{i},{i}\n" for i in range(50)))
    assert files.read_table(spark, p, max_rows=7).count() == 7 and files.read_table(spark, p).count() == 50
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "id long, t string")
    for fmt in ("csv", "parquet"):
        out = str(tmp_path / fmt)
        files.write_table(df, out, fmt)
        files.write_table(df, out, fmt)                               # overwrites
        back = spark.read.option("header", True).csv(out) if fmt == "csv" else spark.read.parquet(out)
        assert sorted((int(r.id), r.t or None) for r in back.collect()) == [(1, "a,b"), (2, None)]
    out = str(tmp_path / "record")
    files.write_json_record(spark, {"b": [1, 2], "a": {"when": DAY}}, out)
    assert json.loads(spark.read.text(out).first().value) == {"a": {"when": "2024-01-01"}, "b": [1, 2]}


def test_store_appends_only_new_texts(spark, tmp_path):
    path = str(tmp_path / "store")
    calls = []

    def embed(d):
        calls.append(sorted(r.text for r in d.collect()))
        return text.hash_embed(d, "text_hash", "text", 8)

    store = TextStore(spark, path, digits=1)
    assert store.read().count() == 0
    first = spark.createDataFrame([(f"text {i % 60}",) for i in range(100)] + [(None,)], "text string")
    assert store.update(first, embed) == 60 and store.read().count() == 60
    before = {f: os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    again = spark.createDataFrame([("text 1",), ("new",), ("new",)], "text string")
    assert store.update(again, embed) == 1 and calls[-1] == ["new"]
    after = {f: os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    assert before.items() <= after.items() and len(after) == len(before) + 1
    assert store.update(again, embed) == 0 and store.read().count() == 61 and store.update(again.limit(0), embed) == 0
    plan = store.missing(again)._jdf.queryExecution().executedPlan().toString()
    used = {r.bucket for r in store.keyed(again).collect()}
    assert len(used) <= 2 and re.search(r"PartitionFilters: \[[^\]]*bucket", plan)      # only the touched folders are read
    for digits in (0, 4):
        with pytest.raises(ValueError):
            TextStore(spark, path, digits)


def test_running_sums_are_spread(spark):
    rows = [(("hot" if i % 3 else None if i % 2 else "b"), i, f"t{i}" * (i % 7)) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, o int, text string").repartition(4)
    got = prefix.running_before(df, ["k"], ["o"], F.length("text"), "sum", ranges=12)
    want, seen = {}, {}
    for k, o, t in rows:
        want[o] = seen.get(k, 0)
        seen[k] = want[o] + len(t)
    assert {r.o: r["sum"] for r in got.collect()} == want
    numbered = prefix.running_before(df, [], ["o"], ranges=5).collect()
    assert all(r.before == r.o for r in numbered)
    inside = prefix.running_before(df, ["k"], ["o"], ranges=12)
    sizes = [r["n"] for r in df.repartitionByRange(12, "k", "o").groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) < 600 / 3 and inside.count() == 900          # the hot key's 600 rows are in no one range


def test_chunks_of_a_hot_day(spark):
    rows = [("A" if i % 3 else "B", i, "t%d " % i * (i % 5 + 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o int, text string").repartition(3)
    whole = {r.k: r.day_text for r in text.same_day_text(df, ["k"], "o").collect()}
    for ranges in (None, 9):
        chunks = text.same_day_chunks(df, ["k"], "o", size=200, ranges=ranges).orderBy("k", "chunk_no").collect()
        assert max(len(c.chunk_text) for c in chunks) < 200 + 60
        assert {k: " ".join(c.chunk_text for c in chunks if c.k == k) for k in whole} == whole


def test_one_date_is_ranked_over_ranges(spark):
    rows = [(DAY if i < 400 else DAY + dt.timedelta(days=i - 399), f"a{i:04d}") for i in range(500)]
    df = spark.createDataFrame(rows, "date date, asset string").repartition(5)
    got = splits.row_splits(df, ["date", "asset"], ranges=10)
    order = {r: i for i, r in enumerate(sorted(rows))}
    for r in got.collect():
        i = order[(r.date, r.asset)] + 1
        assert r.split == ("train" if i <= 350 else "validation" if i <= 425 else "test")


def test_rows_without_a_price_are_no_trading_days(spark):
    rows = [("A", DAY + dt.timedelta(days=i), p) for i, p in enumerate([1.0, None, 2.0, 1.5, None, 3.0])] + [(None, DAY, 1.0), ("A", None, 1.0)]
    df = spark.createDataFrame(rows, "asset string, date date, close double")
    got = targets.direction_target(df, 1).orderBy("date").collect()
    assert [(r.date.day, r.y) for r in got] == [(1, 1), (3, 0), (4, 1)]
    wide = targets.multi_horizon_target(df, (1, 2)).orderBy("horizon", "date").collect()
    assert [(r.horizon, r.date.day, r.future_close, r.y) for r in wide] == [(1, 1, 2.0, 1), (1, 3, 1.5, 0), (1, 4, 3.0, 1), (2, 1, 1.5, 1), (2, 3, 3.0, 1)]


def test_a_planted_leak_is_found(spark):
    bars = spark.createDataFrame([("A", DAY + dt.timedelta(days=i)) for i in range(20)], "asset string, date date")
    days = bars.where(F.dayofmonth("date") % 4 == 0)
    rows = splits.split_by_date(bars)
    for last, leaks in ((1, 0), (-1, 5)):                # a window that reaches one day ahead
        used = align.feature_dates(bars, days, 3, last)
        check = {r.rule: r for r in splits.leak_checklist(rows, used).collect()}
        assert check["feature_after_decision"].violations == (leaks if last < 0 else 0) and check["feature_after_decision"].ok == (last > 0)


def test_ingest_keeps_columns_that_stand_for_the_same(spark):
    raw = spark.createDataFrame([(0, dt.datetime(2024, 1, 2, 16), 1.0, 2.0)], "index int, Date timestamp, adjclose double, `Adj Close` double")
    assert market.ingest_bars(raw).first().asDict() == {"index": 0, "date": dt.date(2024, 1, 2), "adjclose": 1.0, "adj_close": 2.0}
    other = spark.createDataFrame([(dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 3))], "timestamp timestamp, begin timestamp")
    assert market.ingest_bars(other).first().date == dt.date(2024, 1, 3)


def test_profile_names_sources_and_counts_each_asset(spark):
    df = spark.createDataFrame([("up with btc", "x.com"), ("btc and eth", "y"), (None, None)], "text string, source string")
    r = profile.profile_table(df, "t", {"btc": ["btc"], "eth": ["eth"], "sol": ["sol"]}).first()
    assert r.source_cols == "source" and (r.btc_mentions, r.eth_mentions, r.sol_mentions, r.asset_mentions_total) == (2, 1, 0, 3)
    none = profile.profile_table(df.select(F.lit(1).alias("n")), "t", {"btc": ["btc"]}).first()
    assert none.source_cols == "" and none.btc_mentions == 0
