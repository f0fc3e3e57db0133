"""Text-side queries: X1–X13, A1–A6, J1–J3, J8, W16, U1, S14."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textsignal.functions.columns import indexed_explode, word_pattern
from textsignal.operators import align, text
from textsignal.plans import fixtures as fx
from textsignal.plans.registry import register
from textsignal.plans.sql_lib import rnd, round_cols
from textsignal.plans.views_sql import WS, with_views

WC = r"\p{L}\p{N}_"
LEX = fx.SENTIMENT_LEXICON
EMB_DIM = 64
CACHE_CUTOFF = "2024-01-20"   # the embedding store holds texts dated before this day


def _in(words):
    return ", ".join(f"'{w}'" for w in words)


# ------------------------------------------------------------------ X6 / X7 / X8
@register("asset_tags", with_views("""
SELECT doc_id, array_to_string(asset_list, ',') AS assets, CAST(len(asset_list) AS INTEGER) AS n_assets
FROM events_norm""", "events_norm"))
def asset_tags(spark, d):
    """Multi-label asset tags with portable word boundaries."""
    e = fx.events_norm(spark, d)
    return e.select("doc_id", F.array_join("asset_list", ",").alias("assets"), F.size("asset_list").alias("n_assets"))


@register("asset_mentions", with_views(" UNION ALL ".join(
    f"SELECT '{a}' AS asset, count(*) FILTER (WHERE regexp_matches(lower(t), '{word_pattern(ws)}')) AS mentions "
    f"FROM (SELECT coalesce(body, '') AS t FROM news) x"
    for a, ws in fx.NEWS_LEXICON.items()), "news"))
def asset_mentions(spark, d):
    """Number of texts mentioning each asset, one pass over the table."""
    return text.asset_mentions(fx.news(spark, d), ["body"], fx.NEWS_LEXICON)


@register("normalized_events", with_views("""
SELECT doc_id, event_time, event_date, text_len, asset_raw, array_to_string(asset_list, ',') AS assets,
       md5(text) AS text_md5
FROM events_norm""", "events_norm"))
def normalized_events(spark, d):
    """event_time/date, trimmed concatenated text, length, raw asset and asset list."""
    e = fx.events_norm(spark, d)
    return e.select("doc_id", "event_time", "event_date", "text_len", "asset_raw",
                    F.array_join("asset_list", ",").alias("assets"), F.md5("text").alias("text_md5"))


# ------------------------------------------------------------------ X9 / X10 / X11, A1 / A2
_TOK = f"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^{WC}]+'), lambda t: t <> '')"
_SCORED = f"""
  SELECT doc_id, event_date, asset_list, n_words,
         CASE WHEN n_words > 0 THEN CAST(npos AS DOUBLE) / n_words ELSE 0.0 END AS p_pos,
         CASE WHEN n_words > 0 THEN CAST(nneg AS DOUBLE) / n_words ELSE 0.0 END AS p_neg,
         CASE WHEN n_words > 0 THEN CAST(nunc AS DOUBLE) / n_words ELSE 0.0 END AS p_unc
  FROM (SELECT doc_id, event_date, asset_list, CAST(len(tk) AS INTEGER) AS n_words,
               len(list_filter(tk, lambda t: t IN ({_in(LEX['positive'])}))) AS npos,
               len(list_filter(tk, lambda t: t IN ({_in(LEX['negative'])}))) AS nneg,
               len(list_filter(tk, lambda t: t IN ({_in(LEX['uncertain'])}))) AS nunc
        FROM (SELECT doc_id, event_date, asset_list, {_TOK} AS tk FROM events_norm) a) b"""
_SCORED2 = """
  SELECT *, p_pos - p_neg AS score,
         CASE WHEN n_words > 0 THEN CAST(1.0 AS DOUBLE) - p_pos - p_neg ELSE 0.0 END AS p_neu
  FROM scored0"""
_SC = {"scored0": _SCORED, "scored": _SCORED2,
       "scored_by_asset": "SELECT *, unnest(asset_list) AS asset FROM scored"}


def _scored(spark, d):
    return text.score_text(fx.events_norm(spark, d), "text", lexicon=LEX)


@register("lexicon_sentiment", with_views(f"""
SELECT doc_id, n_words, {round_cols(['p_pos', 'p_neg', 'p_neu', 'p_unc', 'score'])}, {rnd('abs(score)')} AS abs_score,
       CASE WHEN score > 0 THEN 'positive' WHEN score < 0 THEN 'negative' ELSE 'neutral' END AS label
FROM scored""", "events_norm", extra=_SC))
def lexicon_sentiment(spark, d):
    """X9 + X10 + X11: native word-list sentiment over whole texts (p_pos, p_neg, p_neu, score, label)."""
    s = _scored(spark, d)
    return s.select("doc_id", "sentiment.n_words", "sentiment.p_pos", "sentiment.p_neg", "sentiment.p_neu",
                    "sentiment.p_unc", "sentiment.score", "sentiment.abs_score", "sentiment.label")


def _daily_sent(spark, d):
    return align.daily_sentiment(align.explode_assets(_scored(spark, d)))


_DS = f"""
  SELECT asset, event_date AS date, count(*) AS n_texts, avg(score) AS mean_score, max(score) AS max_score,
         avg(CAST(score > 0 AS DOUBLE)) AS share_pos, avg(CAST(score < 0 AS DOUBLE)) AS share_neg,
         avg(p_unc) AS uncertainty, avg(p_neg) AS mean_p_neg
  FROM scored_by_asset GROUP BY 1, 2"""


@register("daily_sentiment", with_views(f"""
SELECT asset, date, n_texts, {round_cols(['mean_score', 'max_score', 'share_pos', 'share_neg'])} FROM ds""",
                                        "events_norm", extra={**_SC, "ds": _DS}))
def daily_sentiment(spark, d):
    """A1 + A2: daily mean / max score, count, positive and negative shares per asset."""
    return _daily_sent(spark, d).select("asset", "date", "n_texts", "mean_score", "max_score", "share_pos",
                                        "share_neg")


@register("uncertainty_attention", with_views(f"""
SELECT asset, date, {rnd('uncertainty')} AS uncertainty, {rnd('n_texts * mean_p_neg')} AS neg_attention FROM ds""",
                                              "events_norm", extra={**_SC, "ds": _DS}))
def uncertainty_attention(spark, d):
    """X11: uncertainty share and negative attention (count x negative share) per asset-day."""
    return _daily_sent(spark, d).select("asset", "date", "uncertainty", "neg_attention")


# ------------------------------------------------------------------ A3, J1, J2, J3
_A3 = """
  SELECT asset, event_date AS date, count(*) AS text_count, avg(text_len) AS avg_text_len,
         max(text_len) AS max_text_len, 1 AS has_text
  FROM news_by_asset GROUP BY 1, 2"""


def _a3(spark, d):
    return align.daily_text(fx.news_by_asset(spark, d))


@register("daily_text_features", with_views(f"""
SELECT asset, date, text_count, {rnd('avg_text_len')} AS avg_text_len, max_text_len, has_text FROM a3""",
                                            "news_by_asset", extra={"a3": _A3}))
def daily_text_features(spark, d):
    """A3: per (asset, day) text count, mean and max length, has_text — all assets in one pass."""
    return _a3(spark, d)


@register("bars_with_text", with_views(f"""
SELECT b.asset, b.date, {rnd('b.close')} AS close, coalesce(a.text_count, 0) AS text_count,
       {rnd('coalesce(a.avg_text_len, 0)')} AS avg_text_len, coalesce(a.max_text_len, 0) AS max_text_len,
       coalesce(a.has_text, 0) AS has_text
FROM bars b LEFT JOIN a3 a ON b.asset = a.asset AND b.date = a.date""", "bars", "news_by_asset", extra={"a3": _A3}))
def bars_with_text(spark, d):
    """Bars LEFT JOIN same-day text features (lag 0, missing -> 0)."""
    b = fx.bars(spark, d).select("asset", "date", "close")
    return align.join_same_day(b, _a3(spark, d))


@register("next_day_sentiment_join", with_views(f"""
SELECT b.asset, b.date, {rnd('b.close')} AS close, coalesce(s.n_texts, 0) AS n_texts,
       {rnd('coalesce(s.mean_score, 0)')} AS mean_score
FROM bars b LEFT JOIN (SELECT asset, CAST(date + INTERVAL 1 DAY AS DATE) AS date, n_texts, mean_score FROM ds) s
  ON b.asset = s.asset AND b.date = s.date""", "bars", "events_norm", extra={**_SC, "ds": _DS}))
def next_day_sentiment_join(spark, d):
    """Day-d sentiment joined to the bar of d+1 (calendar), missing -> 0."""
    b = fx.bars(spark, d).select("asset", "date", "close")
    ds = _daily_sent(spark, d).select("asset", "date", "n_texts", "mean_score")
    return align.join_next_day(b, ds)


@register("text_window_10d", with_views(f"""
SELECT b.asset, b.date, coalesce(g.window_text_count, 0) AS window_text_count,
       coalesce(g.window_days, 0) AS window_days, {rnd('coalesce(g.window_mean_score, 0)')} AS window_mean_score,
       CAST(coalesce(g.window_days, 0) > 0 AS INTEGER) AS window_has_text
FROM bars b LEFT JOIN (
  SELECT b2.asset, b2.date, CAST(sum(s.n_texts) AS BIGINT) AS window_text_count, count(*) AS window_days,
         avg(s.mean_score) AS window_mean_score
  FROM bars b2 JOIN ds s ON s.asset = b2.asset AND s.date BETWEEN b2.date - INTERVAL 10 DAY AND b2.date - INTERVAL 1 DAY
  GROUP BY 1, 2) g ON b.asset = g.asset AND b.date = g.date""", "bars", "events_norm", extra={**_SC, "ds": _DS}))
def text_window_10d(spark, d):
    """J3 + A5: texts dated [t-10, t-1] per bar; count = sum, score = mean of daily means."""
    b = fx.bars(spark, d).select("asset", "date")
    ds = _daily_sent(spark, d).select("asset", "date", F.col("n_texts").alias("text_count"), "mean_score")
    out = align.text_window(b, ds, 10, 1)
    return out.select("asset", "date", "window_text_count", "window_days", "window_mean_score", "window_has_text")


# ------------------------------------------------------------------ A4, A5, A6
_TE = {"te_by_asset": "SELECT doc_id, event_date, embedding, unnest(asset_list) AS asset FROM text_emb",
       "dvec": """
  SELECT asset, event_date AS date, i AS dim, avg(CAST(v AS DOUBLE)) AS value, count(*) AS n_texts
  FROM (SELECT asset, event_date, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i
        FROM te_by_asset) x
  GROUP BY 1, 2, 3"""}


def _dvec(spark, d):
    te = align.explode_assets(fx.text_emb(spark, d))
    return align.daily_vector_mean(te.withColumnRenamed("event_date", "date"), ["asset", "date"])


@register("daily_embedding_mean", with_views(f"""
SELECT asset, date, CAST(dim AS INTEGER) AS dim, {rnd('value')} AS value, n_texts FROM dvec""",
                                             "text_emb", extra=_TE))
def daily_embedding_mean(spark, d):
    """A4 + F12: element-wise daily mean embedding and count per (asset, day), long form."""
    g = _dvec(spark, d)
    return g.select("asset", "date", "n_texts", indexed_explode("mean_vector", "dim", "value"))


@register("window_embedding_mean", with_views(f"""
SELECT b.asset, b.date, CAST(g.dim AS INTEGER) AS dim, {rnd('coalesce(w.value, 0)')} AS value,
       coalesce(t.window_texts, 0) AS window_texts
FROM bars b CROSS JOIN (SELECT range AS dim FROM range(0, {EMB_DIM})) g
LEFT JOIN (SELECT b2.asset, b2.date, v.dim, avg(v.value) AS value
           FROM bars b2 JOIN dvec v ON v.asset = b2.asset
             AND v.date BETWEEN b2.date - INTERVAL 10 DAY AND b2.date - INTERVAL 1 DAY
           GROUP BY 1, 2, 3) w ON w.asset = b.asset AND w.date = b.date AND w.dim = g.dim
LEFT JOIN (SELECT b3.asset, b3.date, CAST(sum(n) AS BIGINT) AS window_texts
           FROM bars b3 JOIN (SELECT DISTINCT asset, date, n_texts AS n FROM dvec) v3 ON v3.asset = b3.asset
             AND v3.date BETWEEN b3.date - INTERVAL 10 DAY AND b3.date - INTERVAL 1 DAY
           GROUP BY 1, 2) t ON t.asset = b.asset AND t.date = b.date""", "bars", "text_emb", extra=_TE))
def window_embedding_mean(spark, d):
    """A5: mean of daily mean vectors over [t-10, t-1] per bar; zero vector when no text."""
    b = fx.bars(spark, d).select("asset", "date")
    w = align.window_vector_mean(b, _dvec(spark, d), EMB_DIM, 10, 1)
    return w.select("asset", "date", "window_texts", indexed_explode("window_vector", "dim", "value"))


@register("embedding_norm", with_views(f"""
SELECT doc_id, event_date, {rnd('sqrt(list_sum(list_transform(embedding, lambda x: CAST(coalesce(x, 0) AS DOUBLE) * CAST(coalesce(x, 0) AS DOUBLE))))')}
         AS embedding_norm,
       count(*) OVER (PARTITION BY event_date) AS rows_per_date, 1 AS has_text
FROM text_emb""", "text_emb"))
def embedding_norm(spark, d):
    """A6 + F11 + T15: L2 norm per text, rows of the table on its date, has_text."""
    t = align.text_meta(fx.text_emb(spark, d), "event_date")
    return t.select("doc_id", "event_date", "embedding_norm", "rows_per_date", "has_text")


# ------------------------------------------------------------------ W16, X13, S14
@register("sequence_window", with_views(f"""
SELECT asset, date, CAST(i - 1 AS INTEGER) AS step, ds[i] AS step_date,
       {rnd('coalesce(cs[i], 0.0)')} AS close, {rnd('coalesce(ts[i], 0.0)')} AS text_count, ds[i] IS NULL AS is_pad
FROM (SELECT asset, date, [lag(date, 9) OVER w, lag(date, 8) OVER w, lag(date, 7) OVER w, lag(date, 6) OVER w, lag(date, 5) OVER w, lag(date, 4) OVER w, lag(date, 3) OVER w, lag(date, 2) OVER w, lag(date, 1) OVER w, date] AS ds, [lag(close, 9) OVER w, lag(close, 8) OVER w, lag(close, 7) OVER w, lag(close, 6) OVER w, lag(close, 5) OVER w, lag(close, 4) OVER w, lag(close, 3) OVER w, lag(close, 2) OVER w, lag(close, 1) OVER w, close] AS cs, [lag(CAST(text_count AS DOUBLE), 9) OVER w, lag(CAST(text_count AS DOUBLE), 8) OVER w, lag(CAST(text_count AS DOUBLE), 7) OVER w, lag(CAST(text_count AS DOUBLE), 6) OVER w, lag(CAST(text_count AS DOUBLE), 5) OVER w, lag(CAST(text_count AS DOUBLE), 4) OVER w, lag(CAST(text_count AS DOUBLE), 3) OVER w, lag(CAST(text_count AS DOUBLE), 2) OVER w, lag(CAST(text_count AS DOUBLE), 1) OVER w, CAST(text_count AS DOUBLE)] AS ts
      FROM bt WINDOW w AS (PARTITION BY asset ORDER BY date)) t, range(1, 11) r(i)""",
                                        "bars", "news_by_asset", extra={"a3": _A3, "bt": """
  SELECT b.asset, b.date, b.close, coalesce(a.text_count, 0) AS text_count
  FROM bars b LEFT JOIN a3 a ON a.asset = b.asset AND a.date = b.date"""}))
def sequence_window(spark, d):
    """W16 + F16: last 10 trading rows (close, text_count) per bar, left zero-padded, long form."""
    b = align.join_same_day(fx.bars(spark, d).select("asset", "date", "close"),
                            _a3(spark, d).select("asset", "date", "text_count"))
    seq = align.sequence_window(b, ["close", "text_count"], 10)
    x = seq.select("asset", "date", indexed_explode("sequence", "step", "s"))
    return x.select("asset", "date", "step", "s.step_date", "s.close", "s.text_count",
                    F.col("s.step_date").isNull().alias("is_pad"))


@register("same_day_text", with_views("""
SELECT asset, date, CAST(before // 20000 AS INTEGER) AS chunk_no, count(*) AS n_texts,
       CAST(length(string_agg(text, ' ' ORDER BY doc_id)) AS INTEGER) AS chunk_len,
       md5(string_agg(text, ' ' ORDER BY doc_id)) AS chunk_md5
FROM (SELECT asset, event_date AS date, doc_id, text, coalesce(sum(length(text) + 1) OVER (
        PARTITION BY asset, event_date ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM news_by_asset) p GROUP BY 1, 2, 3""", "news_by_asset"))
def same_day_text(spark, d):
    """All texts of an (asset, day) in document order, as chunks of bounded size (embedding input)."""
    nb = fx.news_by_asset(spark, d).withColumnRenamed("event_date", "date")
    j = text.same_day_chunks(nb, ["asset", "date"], "doc_id")
    return j.select("asset", "date", "chunk_no", F.col("n_texts").cast("long"), F.length("chunk_text").alias("chunk_len"),
                    F.md5("chunk_text").alias("chunk_md5"))


@register("new_texts_only", with_views(f"""
SELECT sha256(text) AS text_hash, min(doc_id) AS first_doc, count(*) AS n_docs FROM events_norm
WHERE sha256(text) NOT IN (SELECT sha256(text) FROM events_norm WHERE event_date < DATE '{CACHE_CUTOFF}')
GROUP BY 1""", "events_norm"))
def new_texts_only(spark, d):
    """Incremental embedding cache — texts whose hash is not in the store (left anti-join); a text
    that repeats is new once."""
    e = fx.events_norm(spark, d).withColumn("text_hash", F.sha2("text", 256))
    store = e.where(F.col("event_date") < F.lit(CACHE_CUTOFF).cast("date"))
    return text.new_texts(e, store).groupBy("text_hash").agg(F.min("doc_id").alias("first_doc"),
                                                             F.count(F.lit(1)).alias("n_docs"))


# ------------------------------------------------------------------ X1, X2, U1 (flare records)
_LINES = f"""
  SELECT asset, date, CAST(line_no AS INTEGER) AS line_no,
         regexp_extract(s, '^(\\d{{4}}-\\d{{2}}-\\d{{2}}):\\s*(.*)$', 1) AS d,
         regexp_extract(s, '^(\\d{{4}}-\\d{{2}}-\\d{{2}}):\\s*(.*)$', 2) AS text
  FROM (SELECT asset, date, generate_subscripts(ls, 1) - 1 AS line_no,
               trim(unnest(ls), {WS}) AS s
        FROM (SELECT asset, date, string_split(text, chr(10)) AS ls FROM flare_raw) a) b"""
_DL = """
  SELECT asset, date, line_no, CAST(try_strptime(d, '%Y-%m-%d') AS DATE) AS text_date, text
  FROM lines WHERE d <> '' AND contains(lower(text), '$' || asset)"""


KEYS = ["asset", "date"]


def _dated_lines(spark, d, numbered=False):
    lines = fx.numbered_flare_lines(spark, d) if numbered else fx.flare_lines(spark, d)
    return text.dated_line_rows(lines, KEYS, cashtag=F.concat(F.lit("$"), F.col("asset")))


@register("dated_lines", with_views("SELECT * FROM dl", "flare_raw", extra={"lines": _LINES, "dl": _DL}))
def dated_lines(spark, d):
    """X1: 'YYYY-MM-DD: text' lines with the record's cashtag, one row per line."""
    return _dated_lines(spark, d, numbered=True).select("asset", "date", F.col("pos").cast("int").alias("line_no"), "text_date", "text")


@register("distinct_texts", with_views("""
SELECT DISTINCT asset, text_date, md5(text) AS text_md5 FROM dl""", "flare_raw", extra={"lines": _LINES, "dl": _DL}))
def distinct_texts(spark, d):
    """Exact duplicate (date, text) pairs removed (the same news line recurs in 3 records); texts are compared by their
    hash, so only that is shuffled."""
    return _dated_lines(spark, d).select("asset", "text_date", F.md5("text").alias("text_md5")).distinct()


@register("decision_date", with_views(f"""
SELECT asset, date,
       CAST(try_strptime(nullif(regexp_extract(query, 'at (\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), ''), '%Y-%m-%d') AS DATE)
         AS decision_date,
       regexp_matches(lower(query), '(^|[^{WC}])(' || asset || ')($|[^{WC}])') AS ticker_match,
       contains(lower(query), '$' || asset) AS cashtag_match
FROM flare_raw""", "flare_raw"))
def decision_date(spark, d):
    """X2 + P9 + P10: decision date from 'at YYYY-MM-DD', whole-word ticker test, cashtag test."""
    fr = fx.flare_queries(spark, d)
    return fr.select("asset", "date", text.decision_date(F.col("query")).alias("decision_date"),
                     text.ticker_filter(F.col("query"), F.col("asset")).alias("ticker_match"),
                     F.contains(F.lower("query"), F.concat(F.lit("$"), F.col("asset"))).alias("cashtag_match"))


# ------------------------------------------------------------------ X3, X4, X5 (instruction records)
_TXT = r"'^\d{4}-\d{2}-\d{2}:\s'"
_ROW = r"'^\d{4}-\d{2}-\d{2},'"
_STRIPF = "lambda x: trim(x, " + WS + ")"
_REC = {
    "recl": f"""
  SELECT asset, date, CAST(pos AS INTEGER) AS pos, l FROM (
    SELECT asset, date, generate_subscripts(arr, 1) AS pos, unnest(arr) AS l FROM (
      SELECT asset, date, list_filter(list_transform(string_split(trim(text, {WS}), chr(10)),
                                                     {_STRIPF}), lambda x: x <> '') AS arr
      FROM flare_raw) a) b""",
    "recf": f"""
  SELECT asset, date, min(pos) FILTER (WHERE regexp_matches(l, {_TXT})) AS first_text FROM recl GROUP BY 1, 2""",
    "rec": f"""
  SELECT r.asset, r.date,
         arg_max(l, pos) FILTER (WHERE starts_with(lower(l), 'context:')) AS ctx,
         arg_min(l, pos) FILTER (WHERE starts_with(lower(l), 'date,')) AS bare,
         count(*) FILTER (WHERE regexp_matches(l, {_ROW}) AND (f.first_text IS NULL OR r.pos < f.first_text))
           AS n_table_lines,
         count(*) FILTER (WHERE regexp_matches(l, {_TXT})) AS n_texts,
         count(DISTINCT trim(regexp_extract(l, '^([^:]*):', 1), {WS}))
           FILTER (WHERE regexp_matches(l, {_TXT})) AS n_text_dates
  FROM recl r JOIN recf f ON r.asset = f.asset AND r.date = f.date GROUP BY 1, 2""",
    "rech": f"""
  SELECT *, CASE WHEN ctx IS NOT NULL
                 THEN list_transform(string_split(trim(regexp_extract(ctx, '^[^:]*:(.*)$', 1), {WS}),
                                                  ','), {_STRIPF})
                 WHEN bare IS NOT NULL THEN list_transform(string_split(bare, ','), {_STRIPF})
                 ELSE [] END AS header
  FROM rec""",
    "trows": f"""
  SELECT asset, date, pos, CAST(try_strptime(parts[1], '%Y-%m-%d') AS DATE) AS row_date,
         list_transform(parts[2:], lambda x: TRY_CAST(x AS DOUBLE)) AS nums, len(parts) AS arity
  FROM (SELECT r.asset, r.date, r.pos, list_transform(string_split(l, ','), {_STRIPF}) AS parts
        FROM recl r JOIN recf f ON r.asset = f.asset AND r.date = f.date
        WHERE regexp_matches(l, {_ROW}) AND (f.first_text IS NULL OR r.pos < f.first_text)) r""",
    "okw": """
  SELECT *, coalesce(CASE WHEN len(header) > 0 AND lower(header[1]) = 'date' THEN len(header) - 1 END,
                     first_value(len(nums)) OVER (PARTITION BY asset, date ORDER BY pos)) AS width
  FROM (SELECT t.*, h.header FROM trows t JOIN rech h ON t.asset = h.asset AND t.date = h.date
        WHERE arity >= 2 AND row_date IS NOT NULL AND row_date <= t.date
          AND len(list_filter(nums, lambda v: v IS NULL)) = 0) o""",
    "kept": """
  SELECT *, row_number() OVER (PARTITION BY asset, date ORDER BY row_date DESC, pos DESC) AS rd,
         count(*) OVER (PARTITION BY asset, date) AS m
  FROM okw WHERE len(nums) = width""",
}


def _records(spark, d):
    """(records with their decision date, table rows, lines) of the instruction records."""
    lines = fx.flare_lines(spark, d)
    records, rows = text.parse_lines(lines, KEYS)
    asked = fx.flare_queries(spark, d).select(*KEYS, text.decision_date(F.col("query")).alias("decision_date"))
    return records.join(asked, KEYS), rows.join(asked, KEYS), lines


@register("record_parse", with_views("""
SELECT asset, date, array_to_string(header, '|') AS header_str, CAST(len(header) AS INTEGER) AS n_header,
       CAST(n_table_lines AS INTEGER) AS n_table_lines, CAST(n_texts AS INTEGER) AS n_texts,
       CAST(n_text_dates AS INTEGER) AS n_text_dates
FROM rech""", "flare_raw", extra=_REC))
def record_parse(spark, d):
    """Header / table rows / dated texts of each instruction record."""
    records, rows, lines = _records(spark, d)
    n_rows = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_table_lines"))
    dates = text.text_lines(lines, KEYS).groupBy(*KEYS, "text_date").agg(F.count(F.lit(1)).alias("n"))
    n_dates = dates.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_text_dates"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("int").alias(c)
    return records.join(n_rows, KEYS, "left").join(n_dates, KEYS, "left").select(
        *KEYS, F.array_join("header", "|").alias("header_str"), F.size("header").alias("n_header"), n("n_table_lines"), n("n_texts"), n("n_text_dates"))


@register("record_rows_valid", with_views(f"""
SELECT asset, date, CAST(least(m, 10) - rd AS INTEGER) AS step, row_date, CAST(len(nums) AS INTEGER) AS n_nums,
       {', '.join(f"{rnd(f'nums[{k + 1}]')} AS num_{k}" for k in range(6))}
FROM kept WHERE rd <= 10""", "flare_raw", extra=_REC))
def record_rows_valid(spark, d):
    """Valid table rows (date <= decision date, all numbers parse, arity = header), last 10."""
    x = text.valid_row_lines(_records(spark, d)[1], KEYS, "decision_date", 10)
    return x.select(*KEYS, "step", "row_date", F.size("nums").alias("n_nums"),
                    *[F.get("nums", F.lit(k)).alias(f"num_{k}") for k in range(6)])


@register("record_skip_counts", with_views("""
SELECT reason, count(*) AS n FROM (
  SELECT CASE WHEN NOT has_price THEN 'no_price' WHEN n_numeric = 0 THEN 'no_features'
              WHEN header_str <> first_header THEN 'inconsistent_header' ELSE 'kept' END AS reason
  FROM (SELECT *, (SELECT arg_min(header_str, (date, asset)) FROM rs x WHERE x.has_price AND x.n_numeric > 0)
                    AS first_header FROM rs) y) z
GROUP BY reason""", "flare_raw", "bars", extra={**_REC, "rs": """
  SELECT h.asset, h.date, array_to_string(h.header, '|') AS header_str,
         coalesce(CASE WHEN len(h.header) > 0 AND lower(h.header[1]) = 'date' THEN len(h.header) - 1 END,
                  (SELECT max(width) FROM okw o WHERE o.asset = h.asset AND o.date = h.date), 0) AS n_numeric,
         EXISTS (SELECT 1 FROM bars b WHERE b.asset = h.asset AND b.date = h.date) AS has_price
  FROM rech h"""}))
def record_skip_counts(spark, d):
    """X5 + J8: records skipped for no price row (anti-join), no numeric features, or a header that
    differs from the first usable record's header; the rest are kept."""
    records, rows, _ = _records(spark, d)
    width = text.valid_row_lines(rows, KEYS, "decision_date", 10).groupBy(*KEYS).agg(F.max("n_numeric").alias("_w"))
    named = F.when((F.size("header") > 0) & (F.lower(F.get("header", F.lit(0))) == "date"), F.size("header") - 1)
    p = records.join(width, KEYS, "left").select(*KEYS, "decision_date", F.array_join("header", "|").alias("header_str"),
                                                 F.coalesce(named, "_w", F.lit(0)).alias("n_numeric"))
    bars = fx.bars(spark, d).select("asset", F.col("date").alias("decision_date"), F.lit(True).alias("has_price"))
    r = p.join(bars, ["asset", "decision_date"], "left").withColumn("has_price", F.coalesce("has_price", F.lit(False)))
    usable = r.where(F.col("has_price") & (F.col("n_numeric") > 0))
    first = usable.agg(F.min_by("header_str", F.struct("decision_date", "asset")).alias("first_header"))
    r = r.withColumn("_k", F.lit(1)).join(F.broadcast(first.withColumn("_k", F.lit(1))), "_k", "left").drop("_k")
    reason = (F.when(~F.col("has_price"), "no_price").when(F.col("n_numeric") == 0, "no_features")
              .when(F.col("header_str") != F.col("first_header"), "inconsistent_header").otherwise("kept"))
    return r.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ A15, J9 + T14, X12
@register("nonzero_sentiment", with_views("""
SELECT asset, count(*) AS n_texts, count(*) FILTER (WHERE score <> 0) AS n_nonzero FROM scored_by_asset GROUP BY asset""",
                                          "events_norm", extra=_SC))
def nonzero_sentiment(spark, d):
    """Texts with a non-zero sentiment score per asset."""
    s = align.explode_assets(_scored(spark, d))
    return s.groupBy("asset").agg(F.count(F.lit(1)).alias("n_texts"),
                                  F.count_if(F.col("sentiment.score") != 0).alias("n_nonzero"))


@register("record_texts", with_views("""
SELECT h.asset, h.date, coalesce(u.used_text_count, 0) AS used_text_count,
       coalesce(u.n_steps_with_text, 0) AS n_steps_with_text
FROM rech h LEFT JOIN (
  SELECT asset, date, CAST(sum(k) AS INTEGER) AS used_text_count, CAST(count(*) FILTER (WHERE k > 0) AS INTEGER)
           AS n_steps_with_text
  FROM (SELECT r.asset, r.date, r.row_date, count(t.l) AS k
        FROM (SELECT * FROM kept WHERE rd <= 10) r
        LEFT JOIN (SELECT asset, date, trim(regexp_extract(l, '^([^:]*):', 1), """ + WS + """) AS tdate, l
                   FROM recl WHERE regexp_matches(l, """ + _TXT + """)) t
          ON t.asset = r.asset AND t.date = r.date AND t.tdate = CAST(r.row_date AS VARCHAR)
             AND r.row_date <= r.date - INTERVAL 1 DAY
        GROUP BY 1, 2, 3) x
  GROUP BY 1, 2) u ON h.asset = u.asset AND h.date = u.date""", "flare_raw", extra=_REC))
def record_texts(spark, d):
    """J9 + T14: per record, texts attached to the kept table rows of the same date, only when
    the row date is at least one day before the decision date (text lag 1); texts of dates
    without a table row are dropped (the reference behaviour), counted here."""
    records, rows, lines = _records(spark, d)
    kept = text.valid_row_lines(rows, KEYS, "decision_date", 10).join(records.select(*KEYS, "decision_date"), KEYS)
    usable = kept.where(F.col("row_date") <= F.date_sub("decision_date", 1)).select(*KEYS, F.col("row_date").cast("string").alias("text_date"))
    found = text.text_lines(lines, KEYS).groupBy(*KEYS, "text_date").agg(F.count(F.lit(1)).alias("n"))
    used = usable.join(found, [*KEYS, "text_date"]).groupBy(*KEYS).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("steps"))
    return records.select(*KEYS).join(used, KEYS, "left").select(
        *KEYS, F.coalesce("n", F.lit(0)).cast("int").alias("used_text_count"), F.coalesce("steps", F.lit(0)).cast("int").alias("n_steps_with_text"))


@register("embed_texts", with_views(f"""
SELECT n.doc_id, coalesce(v.nonzero_dims, 0) AS nonzero_dims, CAST(coalesce(v.n, 0) AS BIGINT) AS n_tokens,
       {rnd("coalesce(v.norm, 0)")} AS embedding_norm, {rnd("coalesce(v.checksum, 0)")} AS checksum
FROM events_norm n LEFT JOIN (
  SELECT doc_id, count(*) AS nonzero_dims, sum(c) AS n, sqrt(sum(c * c)) / sqrt(sum(c * c)) AS norm,
         sum((b + 1) * c) / sqrt(sum(c * c)) AS checksum
  FROM (SELECT doc_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % {EMB_DIM} AS b, count(*)::DOUBLE AS c
        FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[{WC}]+')) AS t FROM events_norm) x GROUP BY 1, 2) y
  GROUP BY doc_id) v ON v.doc_id = n.doc_id""", "events_norm"))
def embed_texts(spark, d):
    """Feature-hashed embedding of every normalised news text (L2-normalised token counts in EMB_DIM
    buckets): non-zero dimensions, tokens, norm (1, or 0 without tokens) and a checksum of the vector."""
    e = text.hash_embed(fx.events_norm(spark, d).select("doc_id", "text"), "doc_id", "text", EMB_DIM)
    from textsignal.functions.columns import l2_norm
    check = F.aggregate(F.transform("embedding", lambda x, i: (i + 1) * x), F.lit(0.0), lambda a, x: a + x)
    return e.select("doc_id", F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("nonzero_dims"),
                    "n_tokens", l2_norm("embedding").alias("embedding_norm"), check.alias("checksum"))


@register("lost_text_days", with_views("""
SELECT s.asset, count(*) AS lost_text_days
FROM (SELECT asset, CAST(date + INTERVAL 1 DAY AS DATE) AS date FROM ds) s
WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.asset = s.asset AND b.date = s.date)
GROUP BY s.asset""", "bars", "events_norm", extra={**_SC, "ds": _DS}))
def lost_text_days(spark, d):
    """T13 audit for J2: text days whose next calendar day has no bar (their sentiment is lost)."""
    b = fx.bars(spark, d).select("asset", "date")
    ds = _daily_sent(spark, d).select("asset", "date")
    return align.lost_text_days(b, ds, 1)
