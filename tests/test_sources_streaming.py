"""Sources (CSV/JSON/parquet, inventory, errors, split union) and the streaming daily aggregate."""

import os
import tempfile

from pyspark.sql import functions as F

from textsignal.plans import fixtures as fx
from textsignal.sources import files
from textsignal.streaming.daily_text import daily_text_stream

from conftest import SF_SMALL


def test_csv_json_inventory_and_errors(spark):
    root = tempfile.mkdtemp(prefix="ts-src-", dir="/tmp")
    with open(os.path.join(root, "a.csv"), "w", encoding="utf-8-sig") as f:
        f.write("Date,Text\n2024-01-01,hello\n")
    with open(os.path.join(root, "b.json"), "w") as f:
        f.write('[{"date": "2024-01-02", "text": "x"}, {"date": "2024-01-03", "text": "y"}]')
    with open(os.path.join(root, "c.txt"), "w") as f:
        f.write("skip me")
    csv = files.read_table(spark, os.path.join(root, "a.csv"), normalize=True)
    assert csv.columns == ["date", "text"] and csv.count() == 1
    js = files.read_table(spark, os.path.join(root, "b.json"))
    assert js.count() == 2
    inv = files.inventory(spark, root).collect()
    assert sorted(r.name for r in inv) == ["a.csv", "b.json"]
    ok, err = files.read_many(spark, [os.path.join(root, "a.csv"), os.path.join(root, "c.txt")])
    assert len(ok) == 1 and err.count() == 1
    u = files.read_splits(spark, {"train": os.path.join(root, "a.csv"), "test": os.path.join(root, "missing.csv")})
    assert [r.split for r in u.collect()] == ["train"]


def test_streaming_daily_text_matches_batch(spark):
    root = tempfile.mkdtemp(prefix="ts-stream-", dir="/tmp")
    src = os.path.join(root, "in")
    news = fx.news(spark, SF_SMALL)
    news.write.parquet(src)
    q = (daily_text_stream(spark, src, news.schema, "event_time", ["body"], "asset_raw", fx.NEWS_LEXICON,
                           watermark="0 seconds")
         .writeStream.outputMode("complete").format("memory").queryName("daily_stream").start())
    q.processAllAvailable()
    q.stop()
    got = {(r.asset, r.date): r.text_count for r in spark.table("daily_stream").collect()}
    from textsignal.operators import align
    exp = {(r.asset, r.date): r.text_count for r in align.daily_text(fx.news_by_asset(spark, SF_SMALL)).collect()}
    assert got == exp
