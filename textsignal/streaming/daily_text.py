"""Optional streaming form of A3: daily text features per asset as a Structured Streaming query.

Texts arrive as files; the event-time watermark (1 day by default) bounds the
state, and each (asset, day) window is emitted once, when the watermark passes
it (append mode), so the next-day join (J2/J3) can run daily on final counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textsignal.functions.columns import explode_computed
from textsignal.operators.text import normalize_events


def daily_text_stream(spark: SparkSession, path: str, schema: StructType, date_col: str, text_cols: Sequence[str],
                      asset_col: str | None, lexicon: Mapping[str, Sequence[str]], fmt: str = "parquet",
                      watermark: str = "1 day", max_files: int = 1) -> DataFrame:
    """Streaming DataFrame of (asset, window start date, text_count, avg_text_len, max_text_len)."""
    raw = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files).load(path)
    ev = normalize_events(raw, date_col, text_cols, asset_col, lexicon)
    # watermarks need a zoned TIMESTAMP: map the wall-clock NTZ time to the same instant in UTC with
    # zone-free arithmetic, so day windows equal calendar days whatever the session time zone
    t = F.col("event_time")
    secs = (F.unix_date(F.to_date(t)).cast("long") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60
            + F.second(t))
    ev = ev.withColumn("event_ts", F.timestamp_seconds(secs))
    by_asset = ev.select("event_ts", "text_len", explode_computed("asset_list", "asset"))
    return (by_asset.withWatermark("event_ts", watermark)
            .groupBy("asset", F.window("event_ts", "1 day"))
            .agg(F.count(F.lit(1)).alias("text_count"), F.avg("text_len").alias("avg_text_len"),
                 F.max("text_len").alias("max_text_len"))
            .select("asset", F.date_from_unix_date(F.floor(F.unix_seconds("window.start") / 86400).cast("int"))
                    .alias("date"), "text_count", "avg_text_len", "max_text_len"))
