"""Dataset-research queries (A7–A12, K3–K5, K7, P15) over the news view split by language
("tables") and the event bars (prices)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textsignal.functions.columns import word_pattern
from textsignal.functions.schema import ASSET_HINTS, DATE_HINTS, SOURCE_HINTS, TEXT_HINTS
from textsignal.operators import profile
from textsignal.plans import fixtures as fx
from textsignal.plans.registry import register
from textsignal.plans.sql_lib import rnd, round_cols
from textsignal.plans.views_sql import with_views
from textsignal.session import materialize
from textsignal.sources.tables import load

LEX_POS = {a: i for i, a in enumerate(fx.NEWS_LEXICON)}
D = "CAST({} AS DOUBLE)".format


def _eba(spark, d):
    return fx.news_by_asset(spark, d).withColumnRenamed("lang", "table_name")


@register("asset_coverage", with_views(f"""
SELECT table_name, asset, CAST(sum(n) AS BIGINT) AS n_events, count(*) AS n_dates, min(event_date) AS date_min,
       max(event_date) AS date_max, {rnd('avg(n)')} AS avg_events_per_active_date,
       {rnd('quantile_cont(n, 0.5)')} AS median_events_per_active_date
FROM (SELECT lang AS table_name, asset, event_date, count(*) AS n FROM news_by_asset GROUP BY 1, 2, 3) d
GROUP BY 1, 2""", "news_by_asset"))
def asset_coverage(spark, d):
    """Events, active dates, range, mean/median events per active date per (table, asset)."""
    return profile.coverage(_eba(spark, d))


_ORDER = "CASE asset " + " ".join(f"WHEN '{a}' THEN {i}" for a, i in LEX_POS.items()) + " END"
_PICKS = f"""
  SELECT table_name, asset, n_events, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY n_events DESC, {_ORDER}) AS rank
    FROM (SELECT lang AS table_name, asset, count(*) AS n_events FROM news_by_asset GROUP BY 1, 2) c) r
  WHERE rank <= 6"""


@register("top_assets", with_views("SELECT * FROM picks", "news_by_asset", extra={"picks": _PICKS}))
def top_assets(spark, d):
    """K5: six most mentioned assets per table (lexicon order breaks ties)."""
    return profile.top_assets(profile.daily_counts(_eba(spark, d)), LEX_POS, 6)


_CAND = {
    "picks": _PICKS,
    "dailyp": """
  SELECT d.* FROM (SELECT lang AS table_name, asset, event_date AS date, count(*) AS text_count
                   FROM news_by_asset GROUP BY 1, 2, 3) d
  JOIN picks p ON d.table_name = p.table_name AND d.asset = p.asset""",
    "rng": "SELECT table_name, asset, min(date) AS lo, max(date) AS hi, count(*) AS news_dates FROM dailyp GROUP BY 1, 2",
    "px": """
  SELECT r.table_name, b.asset, b.date, b.close, r.news_dates FROM bars b JOIN rng r ON b.asset = r.asset
  WHERE b.date >= r.lo - INTERVAL 30 DAY AND b.date < r.hi + INTERVAL 37 DAY""",
    "pr": "SELECT table_name, asset, count(*) AS price_rows FROM px GROUP BY 1, 2",
    "m": """
  SELECT px.*, coalesce(d.text_count, 0) AS text_count, h.horizon
  FROM px LEFT JOIN dailyp d ON px.table_name = d.table_name AND px.asset = d.asset AND px.date = d.date,
       (VALUES (1), (3), (7)) h(horizon)""",
    "m3": """
  SELECT *, CAST(future > close AS DOUBLE) AS y FROM (
    SELECT *, CASE horizon WHEN 1 THEN lead(close, 1) OVER w WHEN 3 THEN lead(close, 3) OVER w
                           ELSE lead(close, 7) OVER w END AS future
    FROM m WINDOW w AS (PARTITION BY table_name, asset, horizon ORDER BY date)) x
  WHERE future IS NOT NULL""",
    "g": """
  SELECT table_name, asset, horizon, first(news_dates) AS news_dates,
         count(*) FILTER (WHERE text_count > 0) AS overlap_news_price_dates,
         CAST(sum(text_count) AS BIGINT) AS total_news_on_price_dates, min(date) AS date_min, max(date) AS date_max,
         avg(CASE WHEN text_count > 0 THEN y END) AS positive_share
  FROM m3 GROUP BY 1, 2, 3""",
    "cand": f"""
  SELECT g.table_name, g.asset, g.horizon, pr.price_rows, g.news_dates, g.overlap_news_price_dates,
         g.total_news_on_price_dates, g.date_min, g.date_max, g.positive_share, bal AS target_balance_score,
         least(overlap_news_price_dates / {D(365)}, {D(1)}) * 35 + least(total_news_on_price_dates / {D(5000)}, {D(1)}) * 35
           + bal * 20 + least(news_dates / {D(365)}, {D(1)}) * 10 AS suitability_score
  FROM (SELECT *, {D(1)} - coalesce(abs(positive_share - {D(0.5)}), {D(0.5)}) * 2 AS bal FROM g) g
  JOIN pr ON g.table_name = pr.table_name AND g.asset = pr.asset"""}
_CCOLS = ["table_name", "asset", "horizon", "price_rows", "news_dates", "overlap_news_price_dates",
          "total_news_on_price_dates", "date_min", "date_max"]
_CSEL = f"{', '.join(_CCOLS)}, {round_cols(['positive_share', 'target_balance_score', 'suitability_score'])}"


def _cands(spark, d):
    # the per-day counts are small (tables x assets x days): materialize once, every step reads them
    daily = materialize(profile.daily_counts(_eba(spark, d)))
    picks = profile.top_assets(daily, LEX_POS, 6)
    bars = materialize(fx.bars(spark, d))
    return profile.candidates(bars, daily, picks, (1, 3, 7), 30, 30)


@register("candidate_overlap", with_views(f"SELECT {_CSEL} FROM cand", "bars", "news_by_asset", extra=_CAND))
def candidate_overlap(spark, d):
    """A11 + A12 + S11: price rows, news dates, overlap, news on price dates, positive share and
    suitability score for every (table, top asset, horizon) in one job."""
    return _cands(spark, d)


@register("dataset_leaderboard", with_views(f"""
SELECT {_CSEL} FROM cand ORDER BY suitability_score DESC, table_name, asset, horizon LIMIT 50""",
                                            "bars", "news_by_asset", extra=_CAND))
def dataset_leaderboard(spark, d):
    """K3: top-50 candidates by suitability score."""
    return profile.leaderboard(_cands(spark, d), 50)


@register("shortlist", with_views(f"""
SELECT {_CSEL}, passes FROM (
  SELECT *, row_number() OVER (ORDER BY suitability_score DESC, table_name, asset, horizon) AS r_all,
         row_number() OVER (PARTITION BY passes ORDER BY suitability_score DESC, table_name, asset, horizon) AS r_ok,
         max(CAST(passes AS INTEGER)) OVER () AS any_ok
  FROM (SELECT *, overlap_news_price_dates >= 30 AND total_news_on_price_dates >= 100 AS passes FROM cand) c) x
WHERE CASE WHEN any_ok = 1 THEN passes AND r_ok <= 15 ELSE r_all <= 10 END""",
                                  "bars", "news_by_asset", extra=_CAND))
def shortlist(spark, d):
    """P15 + K4: >= 30 overlap dates and >= 100 news (top 15), else the top 10 overall."""
    return profile.shortlist(_cands(spark, d), 30, 100, 15, 10)


# ------------------------------------------------------------------ table profiles
def _profile_sql(name: str, src: str, cols: list[str]) -> str:
    def hits(h):
        return [c for c in cols if any(x in c.lower() for x in h)]
    dcols, tcols, acols, scols = hits(DATE_HINTS), hits(TEXT_HINTS), hits(ASSET_HINTS), hits(SOURCE_HINTS)
    parsed = "TRY_CAST(CAST({c} AS VARCHAR) AS TIMESTAMP)"
    if dcols:
        ds = ", ".join(
            f"{{'rate': coalesce(CAST(count({parsed.format(c=c)}) AS DOUBLE) / nullif(count({c}), 0), {D(0)}), "
            f"'neg_ord': {-i}, 'name': '{c}', 'dmin': min({parsed.format(c=c)}), 'dmax': max({parsed.format(c=c)})}}"
            for i, c in enumerate(dcols))
        best_d = f"list_max([{ds}])"
    else:
        best_d = "NULL::STRUCT(rate DOUBLE, neg_ord INTEGER, name VARCHAR, dmin TIMESTAMP, dmax TIMESTAMP)"
    if tcols:
        ts = ", ".join(f"{{'nn': count({c}), 'len': coalesce(avg(length(CAST({c} AS VARCHAR))), {D(0)}), "
                       f"'neg_ord': {-i}, 'name': '{c}'}}" for i, c in enumerate(tcols))
        best_t = f"list_max([{ts}])"
    else:
        best_t = "NULL::STRUCT(nn BIGINT, len DOUBLE, neg_ord INTEGER, name VARCHAR)"
    combo = tcols + acols[:1]
    if combo:
        txt = "concat_ws(' ', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in combo) + ")"
        each = {a: f"count(*) FILTER (WHERE regexp_matches(lower({txt}), '{word_pattern(ws)}'))" for a, ws in fx.NEWS_LEXICON.items()}
    else:
        each = {a: "0" for a in fx.NEWS_LEXICON}
    ment = " + ".join(each.values())
    return f"""
  SELECT '{name}' AS table_name, rows, {len(cols)} AS n_cols, bd.name AS best_date_col,
         coalesce(bd.rate, {D(0)}) AS date_parse_rate, bd.dmin AS date_min, bd.dmax AS date_max,
         bt.name AS best_text_col, coalesce(bt.len, {D(0)}) AS best_text_avg_len,
         '{', '.join(tcols)}' AS text_cols, '{', '.join(acols)}' AS asset_cols, '{', '.join(scols)}' AS source_cols,
         {', '.join(f'CAST(m_{a} AS BIGINT) AS {a}_mentions' for a in each)},
         CAST(mentions AS BIGINT) AS asset_mentions_total,
         least(rows / {D(10000)}, {D(1)}) * 25 + CASE WHEN coalesce(bd.rate, 0) > 0.8 THEN 25 ELSE 0 END
           + CASE WHEN bt.name IS NOT NULL AND coalesce(bt.len, 0) >= 15 THEN 25 ELSE 0 END
           + least(mentions / greatest(rows, 1), {D(1)}) * 25 AS suitability_score_raw
  FROM (SELECT count(*) AS rows, {best_d} AS bd, {best_t} AS bt, {ment} AS mentions,
          {', '.join(f'{m} AS m_{a}' for a, m in each.items())} FROM {src}) a"""


_PROFILED = {"news": ["doc_id", "event_time", "body", "asset_raw", "lang"],
             "conversations": ["conv_id", "turn", "role", "text"],
             "benchmark": ["item_id", "text"], "pages": ["page_id", "url", "html"]}
_PCOLS = ["rows", "n_cols", "best_date_col", "date_min", "date_max", "best_text_col", "text_cols", "asset_cols", "source_cols",
          *[f"{a}_mentions" for a in fx.NEWS_LEXICON], "asset_mentions_total"]


@register("table_profile", with_views(
    " UNION ALL ".join(
        f"SELECT table_name, {', '.join(_PCOLS)}, "
        f"{round_cols(['date_parse_rate', 'best_text_avg_len', 'suitability_score_raw'])} FROM ({_profile_sql(n, n, c)}) p"
        for n, c in _PROFILED.items()), "news"))
def table_profile(spark, d):
    """A8 + A9 + A10 + K7: profile of each text table in one aggregate pass per table."""
    srcs = {"news": fx.news(spark, d), **{n: load(spark, d, n) for n in ("conversations", "benchmark", "pages")}}
    out = None
    for n in _PROFILED:
        p = profile.profile_table(srcs[n], n, fx.NEWS_LEXICON)
        out = p if out is None else out.unionByName(p)
    return out
