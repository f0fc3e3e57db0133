"""Driver contract: entry() runs; a sample of queries equals its DuckDB twin at sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from textsignal.sources.tables import TABLES

from conftest import SF_SMALL

SAMPLE = ["flagship_evaluation", "market_full", "split_by_date", "confusion_metrics", "roc_auc_exact",
          "lexicon_sentiment", "text_window_10d", "record_rows_valid", "candidate_overlap", "dickey_fuller"]


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "balanced_accuracy" in df.columns


def test_every_twin_belongs_to_a_query():      # which queries need none: tests/test_fixes.py
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    sdf = entry.queries()[name](spark, SF_SMALL)
    cols = sorted(sdf.columns)
    a = sorted(tuple(_norm(r[c]) for c in cols) for r in sdf.collect())
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    b = sorted(tuple(_norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert a == b
