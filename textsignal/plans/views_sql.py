"""DuckDB twins of the fixture views in ``plans/fixtures.py`` (oracle side).

``with_views(sql, *names)`` prefixes a query with the CTEs it needs (plus their
dependencies), so each oracle query runs on the driver's pre-registered base
tables alone.
"""

from __future__ import annotations

from textsignal.plans.fixtures import NEWS_LEXICON
from textsignal.functions.columns import word_pattern

NL = "chr(10)"
WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _tag_sql(text: str) -> str:
    items = ", ".join(
        f"CASE WHEN regexp_matches(lower({text}), '{word_pattern(ws)}') THEN '{a}' END"
        for a, ws in NEWS_LEXICON.items())
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def hash_sql(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 12))::BIGINT"


def score_sql(seed: str) -> str:
    return f"(CAST({hash_sql(repr(seed), 'asset', 'CAST(date AS VARCHAR)')} % 10000 AS DOUBLE) / CAST(10000 AS DOUBLE))"


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "bars": ((), """
  SELECT event_type AS asset, CAST(ts AS DATE) AS date,
         arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, ts) AS close, arg_max(value, ts) AS adj_close, count(*) AS volume
  FROM events GROUP BY 1, 2"""),
    "bars_long": ((), """
  SELECT asset, date, arg_min(price, k) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, k) AS close, arg_max(price, k) AS adj_close, sum(l_quantity) AS volume
  FROM (SELECT l_returnflag AS asset, CAST(l_shipdate AS DATE) AS date,
               l_extendedprice / nullif(l_quantity, 0) AS price, l_quantity,
               (l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity,
                l_discount, l_tax) AS k
        FROM lineitem) t
  GROUP BY 1, 2"""),
    "news": ((), """
  SELECT doc_id,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST((doc_id * 7919) % 43200 AS BIGINT)) AS event_time,
         text AS body, source AS asset_raw, lang
  FROM documents"""),
    "events_norm": (("news",), f"""
  SELECT doc_id, lang, event_time, CAST(event_time AS DATE) AS event_date, text,
         CAST(length(text) AS INTEGER) AS text_len, asset_raw, {_tag_sql("text || ' ' || asset_raw")} AS asset_list
  FROM (SELECT doc_id, lang, event_time,
               trim(coalesce(body, ''), {WS}) AS text,
               coalesce(asset_raw, '') AS asset_raw
        FROM news) t
  WHERE event_time IS NOT NULL AND length(text) > 10"""),
    "news_by_asset": (("events_norm",), """
  SELECT doc_id, lang, event_time, event_date, text, text_len, unnest(asset_list) AS asset FROM events_norm"""),
    "flare_rows": (("bars",), f"""
  SELECT asset, date,
         array_to_string(list(printf('%s,%.2f,%.2f,%.2f,%.2f,%.2f,%d', CAST(date AS VARCHAR), open, high, low,
                                     close, adj_close, volume))
                         OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 14 PRECEDING AND CURRENT ROW),
                         {NL}) AS rows
  FROM bars"""),
    "flare_news": (("news_by_asset",), f"""
  SELECT asset, CAST(event_date + CAST(k AS INTEGER) AS DATE) AS date,
         string_agg(line, {NL} ORDER BY event_date, doc_id, line_no) AS news
  FROM (SELECT asset, doc_id, event_date, line_no, unnest(range(0, 3)) AS k,
               CAST(event_date AS VARCHAR) || ': $' || asset || ' ' || raw AS line
        FROM (SELECT asset, doc_id, event_date, line_no, trim(l, {WS}) AS raw
              FROM (SELECT asset, doc_id, event_date, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS l
                    FROM (SELECT *, string_split(text, {NL}) AS ls FROM news_by_asset) a) b) c
        WHERE raw <> '') t
  GROUP BY 1, 2"""),
    "flare_raw": (("flare_rows", "flare_news"), f"""
  SELECT r.asset, r.date, 'Will $' || r.asset || ' rise at ' || CAST(r.date AS VARCHAR) AS query,
         concat_ws({NL}, 'context: date,open,high,low,close,adj-close,volume', r.rows, n.news) AS text
  FROM flare_rows r LEFT JOIN flare_news n ON r.asset = n.asset AND r.date = n.date"""),
    "text_emb": (("events_norm",), """
  SELECT n.doc_id, n.event_date, n.asset_list, e.embedding
  FROM events_norm n JOIN embeddings e ON e.vec_id = n.doc_id"""),
    "bl_y": (("bars_long",), """
  SELECT * EXCLUDE (f1) FROM (
    SELECT *, CAST(lead(close, 1) OVER w > close AS INTEGER) AS y, lead(close, 1) OVER w AS f1
    FROM bars_long WINDOW w AS (PARTITION BY asset ORDER BY date)) t
  WHERE f1 IS NOT NULL"""),
    "bl_split": (("bl_y",), """
  SELECT date, date_rank,
         CASE WHEN date_rank <= n_train THEN 'train'
              WHEN date_rank <= n_train + n_val THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT *, CASE WHEN nt + nv >= n_dates THEN greatest(1, n_dates - 2) ELSE nt END AS n_train,
               CASE WHEN nt + nv >= n_dates THEN 1 ELSE nv END AS n_val
        FROM (SELECT *, greatest(1, floor(n_dates * CAST(0.7 AS DOUBLE))) AS nt,
                     greatest(1, floor(n_dates * CAST(0.15 AS DOUBLE))) AS nv
              FROM (SELECT date, row_number() OVER (ORDER BY date) AS date_rank, count(*) OVER () AS n_dates
                    FROM (SELECT DISTINCT date FROM bl_y) d) d2) d3) d4"""),
    "labelled": (("bl_y", "bl_split"), """
  SELECT b.*, s.split FROM bl_y b JOIN bl_split s ON b.date = s.date"""),
    "preds_base": (("labelled",), f"""
  SELECT asset, date, split, y AS y_true, {score_sql('a')} AS sa,
         CASE WHEN y = 1 THEN least(CAST(1.0 AS DOUBLE), {score_sql('b')} + CAST(0.1 AS DOUBLE))
              ELSE {score_sql('b')} END AS sb
  FROM labelled"""),
    "preds": (("preds_base",), """
  SELECT 'market_full' AS model, asset, date, split, y_true, sa AS y_proba FROM preds_base
  UNION ALL SELECT 'text' AS model, asset, date, split, y_true, sb AS y_proba FROM preds_base
  UNION ALL SELECT 'market_text' AS model, asset, date, split, y_true, (sa + sb) / CAST(2.0 AS DOUBLE) AS y_proba
  FROM preds_base"""),
}


def _order(names: tuple[str, ...]) -> list[str]:
    seen: list[str] = []

    def visit(n: str):
        if n in seen:
            return
        for dep in VIEWS[n][0]:
            visit(dep)
        seen.append(n)
    for n in names:
        visit(n)
    return seen


def with_views(sql: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the CTEs for ``names`` (dependencies first) and ``extra`` CTEs."""
    parts = [f"{n} AS ({VIEWS[n][1]}\n)" for n in _order(names)]
    for k, v in (extra or {}).items():
        parts.append(f"{k} AS ({v}\n)")
    return ("WITH " + ",\n".join(parts) + "\n" + sql) if parts else sql
