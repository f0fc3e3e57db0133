"""Text operators (X1–X13, S14): parsing, asset tagging, lexicon scoring, embedding hooks.

Everything up to the first daily aggregate is map-only (no shuffle): lines are
exploded or handled with array higher-order functions inside the row, asset
tagging is one regex per asset, the default sentiment scorer counts words in
native functions.  Model inference (X9/X12 with a real model) is the only
Python stage: an iterator ``pandas_udf`` that loads the model once per task
and scores Arrow batches.
"""

from __future__ import annotations

import re

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textsignal.functions.columns import WORD_CHAR, col_, indexed_explode, tokens, word_pattern
from textsignal.operators.prefix import running_before

# The default crypto lexicon (asset -> keywords) of the reference study.
CRYPTO_LEXICON = {
    "BTC": ["btc", "bitcoin", "xbt"],
    "ETH": ["eth", "ethereum", "ether"],
    "SOL": ["sol", "solana"],
    "BNB": ["bnb", "binance coin", "binance"],
    "XRP": ["xrp", "ripple"],
    "ADA": ["ada", "cardano"],
    "DOGE": ["doge", "dogecoin"],
    "AVAX": ["avax", "avalanche"],
    "MATIC": ["matic", "polygon"],
    "DOT": ["dot", "polkadot"],
    "LINK": ["link", "chainlink"],
    "LTC": ["ltc", "litecoin"],
}

DATED_LINE = r"^(\d{4}-\d{2}-\d{2}):\s*(.*)$"         # T20: the ':\s*' form
DATED_TEXT_STRICT = r"^\d{4}-\d{2}-\d{2}:\s"            # X3 text line
TABLE_ROW = r"^\d{4}-\d{2}-\d{2},"                      # X3 table row


WHITESPACE = " \t\n\x0b\x0c\r"   # the regex class \s: space, tab, LF, VT, FF, CR


def pystrip(c: Column) -> Column:
    """``str.strip()`` over the ASCII whitespace class (not only spaces, unlike ``trim``);
    a character-set trim, no regex."""
    return F.btrim(c, F.lit(WHITESPACE))


def compact(arr: Column, elem_type: str = "string") -> Column:
    """Drop NULL elements without a lambda (``array_compact`` is a ``filter`` HOF, which turns
    whole-stage codegen and common-subexpression elimination off for the projection)."""
    return F.array_except(arr, F.array(F.lit(None).cast(elem_type)))


# ---------------------------------------------------------------- X6 / X7 / X8
def asset_match(text: Column, words: Sequence[str]) -> Column:
    return F.lower(text).rlike(word_pattern(words))


def _is_word(w: str) -> bool:
    return all(ch.isalnum() or ch == "_" for ch in w)


def keyword_hits(text: Column, words: Sequence[str]) -> Column:
    """Distinct single-word keywords found in the lower-cased text, in ONE regex pass
    (whole-token matches: not preceded / followed by a letter, digit or underscore)."""
    alt = "|".join(re.escape(w.lower()) for w in sorted(set(words), key=len, reverse=True))
    pat = rf"(?<![{WORD_CHAR}])({alt})(?![{WORD_CHAR}])"
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pat), 1))


def _asset_conditions(text: Column, lexicon: Mapping[str, Sequence[str]]) -> list[Column]:
    """One boolean per asset.  Single-word keywords are looked up in the one-pass hit list
    (two whole-token matches cannot overlap); multi-word phrases keep their own regex so that
    overlapping phrase matches are not lost."""
    singles = sorted({w.lower() for ws in lexicon.values() for w in ws if _is_word(w)})
    hits = keyword_hits(text, singles) if singles else None
    conds = []
    for ws in lexicon.values():
        one = [w.lower() for w in ws if _is_word(w)]
        multi = [w for w in ws if not _is_word(w)]
        c = F.arrays_overlap(hits, F.array(*[F.lit(w) for w in one])) if one else F.lit(False)
        if multi:
            c = c | asset_match(text, multi)
        conds.append(c)
    return conds


def tag_assets(text: Column, lexicon: Mapping[str, Sequence[str]]) -> Column:
    """Multi-label asset list in lexicon order (portable word boundaries, T8)."""
    return compact(F.array(*[F.when(c, F.lit(a)) for a, c in zip(lexicon, _asset_conditions(text, lexicon))]))


def asset_mentions(df: DataFrame, text_cols: Sequence[str], lexicon: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows mentioning each asset, in a single pass (one conditional count per asset)."""
    text = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in text_cols])
    hits = df.select(F.array(*[c.alias(f"c{i}") for i, c in enumerate(_asset_conditions(text, lexicon))]).alias("h"))
    wide = hits.agg(*[F.count_if(F.col("h")[i]).alias(f"m{i}") for i in range(len(lexicon))])
    pairs = F.array(*[F.struct(F.lit(a).alias("asset"), F.col(f"m{i}").alias("mentions"))
                      for i, a in enumerate(lexicon)])
    return wide.select(F.explode(pairs).alias("p")).select("p.asset", "p.mentions")


def normalize_events(df: DataFrame, date_col: str, text_cols: Sequence[str], asset_col: str | None,
                     lexicon: Mapping[str, Sequence[str]], min_len: int = 10,
                     keep: Sequence[str] = ()) -> DataFrame:
    """(event_time, event_date, text, text_len, asset_raw, asset_list) in one projection.

    Dates are parsed leniently (T2); unparsable rows and texts of ``<= min_len`` chars are
    dropped (P11).  The asset regex sees ``text + ' ' + asset_raw`` lower-cased.
    """
    dt = df.schema[date_col].dataType
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        ts = F.col(date_col)
    elif isinstance(dt, T.DateType):
        ts = F.col(date_col).cast("timestamp_ntz")
    else:
        ts = F.try_to_timestamp(F.col(date_col).cast("string")).cast("timestamp_ntz")
    text = pystrip(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in text_cols]))
    raw = F.coalesce(F.col(asset_col).cast("string"), F.lit("")) if asset_col else F.lit("")
    out = (df.select(*keep, ts.alias("event_time"), text.alias("text"), raw.alias("asset_raw"))
           .where(F.col("event_time").isNotNull() & (F.length("text") > min_len)))
    return out.select(*keep, "event_time", F.to_date("event_time").alias("event_date"), "text",
                      F.length("text").alias("text_len"), "asset_raw",
                      tag_assets(F.concat_ws(" ", "text", "asset_raw"), lexicon).alias("asset_list"))


# ---------------------------------------------------------------- X1 / X2
def dated_lines(df: DataFrame, text_col: str, cashtag: str | Column | None = None,
                keep: Sequence[str] = ()) -> DataFrame:
    """Text block -> one row per ``YYYY-MM-DD: text`` line (optionally only lines with the
    cashtag), with the line position.  Map-only: explode + regexp_extract."""
    lines = df.select(*keep, indexed_explode(F.split(F.col(text_col), "\n"), "pos", "line"))
    return dated_line_rows(lines, keep, cashtag).withColumnRenamed("pos", "line_no")


def dated_line_rows(lines: DataFrame, keep: Sequence[str], cashtag: str | Column | None = None) -> DataFrame:
    """X1 over lines (keep, pos, line): (keep, pos, text_date, text)."""
    s = pystrip(F.col("line"))
    x = lines.select(*keep, "pos", F.regexp_extract(s, DATED_LINE, 1).alias("_d"), F.regexp_extract(s, DATED_LINE, 2).alias("text"))
    x = x.where(F.col("_d") != "")
    if cashtag is not None:
        tag = F.lower(col_(cashtag)) if not isinstance(cashtag, str) else F.lit(cashtag.lower())
        x = x.where(F.contains(F.lower("text"), tag))
    return x.select(*keep, "pos", F.try_to_date("_d", "yyyy-MM-dd").alias("text_date"), "text")


def decision_date(query: Column) -> Column:
    """``at YYYY-MM-DD`` inside the query -> DATE (NULL if absent/invalid)."""
    d = F.regexp_extract(query, r"at (\d{4}-\d{2}-\d{2})", 1)
    return F.when(d != "", F.try_to_date(d, "yyyy-MM-dd"))


def ticker_filter(query: Column, ticker: str | Column) -> Column:
    """Case-insensitive whole-word ticker test (portable boundary, T8)."""
    if isinstance(ticker, str):
        return F.lower(query).rlike(word_pattern([ticker]))
    b = r"\p{L}\p{N}_"
    pat = F.concat(F.lit(f"(^|[^{b}])("), F.lower(ticker), F.lit(f")($|[^{b}])"))
    return F.regexp(F.lower(query), pat)


# ---------------------------------------------------------------- X3 / X4 / X5
def parse_records(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Instruction record -> header, table rows, dated texts, all inside the row.

    State rule: table rows count only before the first dated text line; a ``context:``
    line always resets the header, a bare ``date,`` line sets it only if none is set yet
    (so the final header is the last ``context:`` line, else the first bare one).
    Arrays are staged in separate projections so every line is split and classified once.
    """
    cols = df.columns
    lines = F.filter(F.transform(F.split(pystrip(F.col(text_col)), "\n"), lambda l: pystrip(l)),
                     lambda l: l != F.lit(""))
    s1 = df.select(*cols, lines.alias("_lines"))
    kinds = F.transform("_lines", lambda l, i: F.struct(
        i.alias("i"), l.alias("l"), l.rlike(DATED_TEXT_STRICT).alias("is_text"), l.rlike(TABLE_ROW).alias("is_row"),
        F.lower(l).startswith("context:").alias("is_ctx"), F.lower(l).startswith("date,").alias("is_bare")))
    s2 = s1.select(*cols, kinds.alias("_k"))
    first_text = F.array_position(F.transform("_k", lambda e: e["is_text"]), True)
    ctx = F.try_element_at(F.filter("_k", lambda e: e["is_ctx"]), F.lit(-1))["l"]
    bare = F.try_element_at(F.filter("_k", lambda e: e["is_bare"]), F.lit(1))["l"]
    s3 = s2.select(*cols, "_k", first_text.alias("_ft"), ctx.alias("_ctx"), bare.alias("_bare"))
    ctx_header = F.transform(F.split(pystrip(F.regexp_extract("_ctx", r"^[^:]*:(.*)$", 1)), ","),
                             lambda x: pystrip(x))
    bare_header = F.transform(F.split("_bare", ","), lambda x: pystrip(x))
    header = F.when(F.col("_ctx").isNotNull(), ctx_header).when(F.col("_bare").isNotNull(), bare_header).otherwise(
        F.array().cast("array<string>"))
    ft = F.col("_ft")
    table = F.transform(F.filter("_k", lambda e: ((ft == 0) | (e["i"] < ft - 1)) & e["is_row"]), lambda e: e["l"])
    texts = F.transform(F.filter("_k", lambda e: e["is_text"]),
                        lambda e: F.struct(pystrip(F.regexp_extract(e["l"], r"^([^:]*):", 1)).alias("date"),
                                           pystrip(F.regexp_extract(e["l"], r"^[^:]*:(.*)$", 1)).alias("text")))
    return s3.select(*cols, header.alias("header"), table.alias("table_lines"), texts.alias("texts"))


def valid_rows(parsed: DataFrame, decision: str = "decision_date", max_days: int = 10) -> DataFrame:
    """Keep table rows dated <= decision date whose values all parse as doubles and whose
    arity equals the header's numeric width; sort by date (stable) and keep the last ``max_days``.

    Adds ``rows`` (ARRAY<STRUCT<date, nums>>), ``numeric_names`` and ``n_numeric``.
    """
    cols = parsed.columns
    h = F.col("header")
    named = F.when((F.size(h) > 0) & (F.lower(F.try_element_at(h, F.lit(1))) == "date"), F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))))
    parts = F.transform("table_lines", lambda l, i: F.struct(
        i.alias("i"), F.transform(F.split(l, ","), lambda x: pystrip(x)).alias("p")))
    s1 = parsed.select(*cols, named.alias("_named"), parts.alias("_parts"))
    cand = F.transform("_parts", lambda e: F.struct(
        F.try_to_date(F.try_element_at(e["p"], F.lit(1)), "yyyy-MM-dd").alias("date"), e["i"].alias("i"),
        F.transform(F.slice(e["p"], 2, F.greatest(F.size(e["p"]) - 1, F.lit(0))), lambda x: x.try_cast("double")).alias("nums"),
        F.size(e["p"]).alias("arity")))
    s2 = s1.select(*cols, "_named", cand.alias("_cand"))
    ok = F.filter("_cand", lambda e: (e["arity"] >= 2) & e["date"].isNotNull() & (e["date"] <= F.col(decision))
                  & F.forall(e["nums"], lambda v: v.isNotNull()))
    s3 = s2.select(*cols, "_named", ok.alias("_ok"))
    # width when no header: the first parsed row fixes it (reference fallback)
    width = F.coalesce(F.when(F.col("_named").isNotNull(), F.size("_named")),
                       F.when(F.size("_ok") > 0, F.size(F.try_element_at("_ok", F.lit(1))["nums"])))
    s4 = s3.select(*cols, "_named", "_ok", width.alias("_w"))
    kept = F.filter("_ok", lambda e: F.size(e["nums"]) == F.col("_w"))
    ordered = F.array_sort(kept)   # struct order: (date, line index) -> stable date sort
    s5 = s4.select(*cols, "_named", "_w", ordered.alias("_o"))
    n = F.size("_o")
    last = F.when(n <= max_days, F.col("_o")).otherwise(F.slice("_o", n - max_days + 1, max_days))
    rows = F.transform(last, lambda e: F.struct(e["date"].alias("date"), e["nums"].alias("nums")))
    names = F.coalesce(F.col("_named"), F.transform(F.sequence(F.lit(0), F.greatest(F.col("_w") - 1, F.lit(0))),
                                                    lambda i: F.concat(F.lit("numeric_"), i.cast("string"))))
    return s5.select(*cols, rows.alias("rows"),
                     F.when(F.col("_w") > 0, names).otherwise(F.array().cast("array<string>")).alias("numeric_names"),
                     F.coalesce(F.col("_w"), F.lit(0)).alias("n_numeric"))


# ---------------------------------------------------------------- X1 / X3 / X4 over lines
def record_lines(df: DataFrame, text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(keep, pos, line): one row per line of a text block.  The operators below take such lines, however they came about, so
    that a record with very many lines is never one row."""
    return df.select(*keep, indexed_explode(F.split(F.col(text_col), "\n"), "pos", "line")).withColumn("pos", F.col("pos").cast("long"))


def classified(lines: DataFrame) -> DataFrame:
    """The non-blank lines, stripped, with their kind: text, row, context, bare or other; a context line may be
    one of the first two as well, so kinds are flags."""
    s = lines.withColumn("line", pystrip(F.col("line"))).where(F.col("line") != "")
    return s.withColumn("is_text", F.col("line").rlike(DATED_TEXT_STRICT)).withColumn("is_row", F.col("line").rlike(TABLE_ROW)).withColumn(
        "is_ctx", F.lower("line").startswith("context:")).withColumn("is_bare", F.lower("line").startswith("date,"))


def parse_lines(lines: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """X3 over lines: (records, table rows).  ``records``: keys, header, n_lines of the record's texts and the place of the first;
    ``rows``: keys, pos, line of the table lines before it.  Text lines only enter partial aggregates (a count and the
    smallest place); what is joined are the few header and table lines."""
    keys, k = list(keys), classified(lines)
    head = k.groupBy(*keys).agg(F.count_if("is_text").alias("n_texts"), F.min(F.when(F.col("is_text"), F.col("pos"))).alias("first_text"),
                                F.max(F.when(F.col("is_ctx"), F.col("pos"))).alias("ctx_pos"),
                                F.min(F.when(F.col("is_bare"), F.col("pos"))).alias("bare_pos"))
    marks = k.where(F.col("is_ctx") | F.col("is_bare")).select(*keys, F.col("pos").alias("mark"), F.col("line").alias("head_line"))
    head = head.withColumn("mark", F.coalesce("ctx_pos", "bare_pos")).join(marks, [*keys, "mark"], "left")
    names = F.when(F.col("ctx_pos").isNotNull(), F.split(pystrip(F.regexp_extract("head_line", r"^[^:]*:(.*)$", 1)), ",")) \
        .when(F.col("bare_pos").isNotNull(), F.split("head_line", ",")).otherwise(F.array().cast("array<string>"))
    records = head.select(*keys, F.transform(names, lambda x: pystrip(x)).alias("header"), "n_texts", "first_text")
    rows = k.where("is_row").select(*keys, "pos", "line").join(records, keys).where(
        F.col("first_text").isNull() | (F.col("pos") < F.col("first_text")))
    return records, rows.select(*keys, "pos", "line", "header")


def text_lines(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """X3 over lines: (keys, pos, text_date, text) of the dated text lines; the date as it is written."""
    k = classified(lines).where("is_text")
    return k.select(*keys, "pos", pystrip(F.regexp_extract("line", r"^([^:]*):", 1)).alias("text_date"),
                    pystrip(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)).alias("text"))


def valid_row_lines(rows: DataFrame, keys: Sequence[str], decision: str, max_days: int = 10) -> DataFrame:
    """X4 over lines: (keys, step, row_date, nums, n_numeric) of the last ``max_days`` valid table rows of each record.  The windows
    hold one record's table rows."""
    keys = list(keys)
    parts = rows.withColumn("_p", F.transform(F.split("line", ","), lambda x: pystrip(x)))
    ok = parts.select(*keys, "pos", "header", F.try_to_date(F.get("_p", F.lit(0)), "yyyy-MM-dd").alias("row_date"), F.size("_p").alias("arity"),
                      F.transform(F.slice("_p", 2, F.greatest(F.size("_p") - 1, F.lit(0))), lambda x: x.try_cast("double")).alias("nums"))
    ok = ok.where((F.col("arity") >= 2) & F.col("row_date").isNotNull() & (F.col("row_date") <= F.col(decision))
                  & F.forall("nums", lambda v: v.isNotNull()))
    named = F.when((F.size("header") > 0) & (F.lower(F.get("header", F.lit(0))) == "date"), F.size("header") - 1)
    first = F.first(F.size("nums")).over(Window.partitionBy(*keys).orderBy("pos"))     # no header: the first parsed row fixes the width
    kept = ok.withColumn("n_numeric", F.coalesce(named, first)).where(F.size("nums") == F.col("n_numeric"))
    late = Window.partitionBy(*keys).orderBy(F.desc("row_date"), F.desc("pos"))
    kept = kept.withColumn("_back", F.row_number().over(late)).where(F.col("_back") <= max_days)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return kept.select(*keys, (n - F.col("_back")).cast("int").alias("step"), "row_date", "nums", "n_numeric")


# ---------------------------------------------------------------- X9 / X10 / X11
def _count_words(lower_text: Column, words: Sequence[str]) -> Column:
    alt = "|".join(re.escape(w.lower()) for w in words)
    return F.regexp_count(lower_text, F.lit(rf"(?<![{WORD_CHAR}])(?:{alt})(?![{WORD_CHAR}])"))


def lexicon_scores(text: Column, lexicon: Mapping[str, Sequence[str]]) -> Column:
    """X9/X10/X11 native default: word-list shares over the *whole* text as one struct:
    n_words, p_pos, p_neg, p_neu, p_unc, score = p_pos - p_neg, abs_score, label.
    Blank text -> zeros and label 'neutral'.

    Words are maximal runs of letters/digits/underscore; each share is the number of whole-word
    matches of the list over the number of words, counted with ``regexp_count`` (no token
    array, no lambda: the projection stays in whole-stage codegen)."""
    lt = F.lower(F.coalesce(text, F.lit("")))
    return _shares(F.regexp_count(lt, F.lit(f"[{WORD_CHAR}]+")).cast("int"), _count_words(lt, lexicon["positive"]),
                   _count_words(lt, lexicon["negative"]), _count_words(lt, lexicon["uncertain"]))


def _shares(n, npos, nneg, nunc) -> Column:
    n, npos, nneg, nunc = (col_(c) for c in (n, npos, nneg, nunc))

    def share(c):
        return F.when(n > 0, c / n).otherwise(F.lit(0.0))
    p_pos, p_neg, p_unc = share(npos), share(nneg), share(nunc)
    score = p_pos - p_neg
    return F.struct(n.alias("n_words"), p_pos.alias("p_pos"), p_neg.alias("p_neg"),
                    F.when(n > 0, 1.0 - p_pos - p_neg).otherwise(F.lit(0.0)).alias("p_neu"),
                    p_unc.alias("p_unc"), score.alias("score"), F.abs(score).alias("abs_score"),
                    F.when(score > 0, "positive").when(score < 0, "negative").otherwise("neutral").alias("label"))


def _scored(fn, texts: pd.Series) -> pd.DataFrame:
    """Scores of a batch.  A batch that fails is retried in halves, down to the texts that fail by
    themselves: only they score 0 and are marked."""
    try:
        out = fn(texts).reset_index(drop=True)
        return out.assign(p_unc=out["p_unc"] if "p_unc" in out else 0.0, failed=False)
    except Exception:  # noqa: BLE001 - a user's scorer may raise anything
        if len(texts) == 1:
            return pd.DataFrame({"p_pos": [0.0], "p_neg": [0.0], "p_neu": [1.0], "p_unc": [0.0], "failed": [True]})
    half = len(texts) // 2
    return pd.concat([_scored(fn, texts.iloc[:half]), _scored(fn, texts.iloc[half:])], ignore_index=True)


def score_text(df: DataFrame, text_col: str, scorer: Callable[[], Callable[[pd.Series], pd.DataFrame]] | None = None,
               lexicon: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Sentiment per text as a struct ``sentiment``, with the same fields on both paths, and a column
    ``scorer_failed``.

    ``lexicon`` (word lists ``positive``, ``negative``, ``uncertain``): native shares, no Python.
    ``scorer`` is a *factory* returning ``f(texts: pd.Series) -> DataFrame[p_pos, p_neg, p_neu]`` (and
    ``p_unc``, else 0); it is called once per task inside an iterator ``pandas_udf`` (model loaded once,
    Arrow batches).  Blank texts score 0; so does a text on which the scorer fails, which is counted.
    """
    if (scorer is None) == (lexicon is None):
        raise ValueError("give a lexicon or a scorer")
    lt = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    n_words = F.regexp_count(lt, F.lit(f"[{WORD_CHAR}]+")).cast("int")
    if scorer is None:
        # counts first (one regex pass each), shares in a second projection: the struct below
        # references every count several times and must not re-run the regexes
        counts = df.select("*", n_words.alias("_nw"),
                           _count_words(lt, lexicon["positive"]).alias("_np"),
                           _count_words(lt, lexicon["negative"]).alias("_nn"),
                           _count_words(lt, lexicon["uncertain"]).alias("_nu"))
        return counts.select(*df.columns, _shares("_nw", "_np", "_nn", "_nu").alias("sentiment"),
                             F.lit(False).alias("scorer_failed"))
    fields = ["p_pos", "p_neg", "p_neu", "p_unc", "failed"]

    @F.pandas_udf("p_pos double, p_neg double, p_neu double, p_unc double, failed boolean")
    def _score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fn = scorer()
        for s in batches:
            blank = (s.fillna("").str.strip() == "").to_numpy()
            out = _scored(fn, s.fillna("")) if len(s) else pd.DataFrame(columns=fields)
            out.loc[blank, ["p_pos", "p_neg", "p_neu", "p_unc"]] = 0.0
            out.loc[blank, "failed"] = False
            yield out[fields].astype({"failed": bool})

    d = df.withColumn("_p", _score(F.col(text_col))).withColumn("_nw", n_words)
    score = F.col("_p.p_pos") - F.col("_p.p_neg")
    return d.select(*df.columns, F.struct(
        F.col("_nw").alias("n_words"), F.col("_p.p_pos").alias("p_pos"), F.col("_p.p_neg").alias("p_neg"),
        F.col("_p.p_neu").alias("p_neu"), F.col("_p.p_unc").alias("p_unc"), score.alias("score"),
        F.abs(score).alias("abs_score"),
        F.when(score > 0, "positive").when(score < 0, "negative").otherwise("neutral").alias("label")).alias("sentiment"),
        F.col("_p.failed").alias("scorer_failed"))


def embed_text(df: DataFrame, text_col: str, encoder: Callable[[], Callable[[list[str]], list[list[float]]]],
               dim: int, batch_size: int = 16, out_col: str = "embedding") -> DataFrame:
    """Batched text embedding through an iterator ``pandas_udf``; ``encoder`` is a factory
    (model loaded once per task).  Blank text -> zero vector."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = encoder()
        zero = [0.0] * dim
        for s in batches:
            texts = s.fillna("").tolist()
            out: list = [zero] * len(texts)
            idx = [i for i, t in enumerate(texts) if t.strip()]
            for j in range(0, len(idx), batch_size):
                chunk = idx[j:j + batch_size]
                vecs = fn([texts[i] for i in chunk])
                for i, v in zip(chunk, vecs):
                    out[i] = [float(x) for x in v]
            yield pd.Series(out)
    return df.withColumn(out_col, _embed(F.col(text_col)))


def hash_embed(df: DataFrame, key: str, text_col: str, dim: int) -> DataFrame:
    """X12 native: (key, n_tokens, embedding), the L2-normalised counts of a text's word tokens in ``dim``
    md5 buckets.  Tokens are counted per (key, bucket) with partial aggregates, so a text of any length
    becomes at most ``dim`` rows; a text without tokens has the zero vector."""
    tokens = df.select(F.col(key), F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(f"[{WORD_CHAR}]+"), F.lit(0))).alias("t"))
    bucket = F.conv(F.substring(F.md5("t"), 1, 8), 16, 10).cast("long") % dim
    counts = tokens.groupBy(key, bucket.cast("int").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    norm = F.sqrt(F.sum(F.col("c").cast("double") * F.col("c")))
    v = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("b", "c"))).alias("m"), norm.alias("l2"),
                                F.sum("c").alias("n_tokens"))
    each = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                       lambda i: F.coalesce(F.try_element_at("m", i) / F.col("l2"), F.lit(0.0)))
    return df.select(key).join(v, key, "left").select(key, F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"),
                                                      each.alias("embedding"))


def new_texts(texts: DataFrame, store: DataFrame, key: str = "text_hash", text_col: str = "text") -> DataFrame:
    """Texts whose hash is not yet in the embedding store (left anti-join), so only
    new texts reach the inference stage; results are appended to the store by the caller."""
    t = texts if key in texts.columns else texts.withColumn(key, F.sha2(F.col(text_col), 256))
    return t.join(store.select(key).distinct(), key, "left_anti")


def update_store(texts: DataFrame, store: DataFrame, embed: Callable[[DataFrame], DataFrame], text_col: str = "text") -> DataFrame:
    """The store with the vectors of the texts that it lacks.  ``embed`` gets one row per new text
    (text_hash, text) and returns (text_hash, embedding)."""
    fresh = new_texts(texts.select(text_col), store, "text_hash", text_col).dropDuplicates(["text_hash"])
    return store.select("text_hash", "embedding").unionByName(embed(fresh).select("text_hash", "embedding"))


# ---------------------------------------------------------------- X13
def same_day_chunks(df: DataFrame, keys: Sequence[str], order: str, text_col: str = "text", size: int = 20_000,
                    ranges: int | None = None) -> DataFrame:
    """X13 in bounded rows: the texts of a key in ``order``, as numbered chunks of about ``size`` characters
    (a text is never cut, so a chunk is at most that plus one text).  The chunks joined by a space are
    ``same_day_text``; an encoder scores chunks and combines them.  The running length is a two-level prefix
    sum, so a day that holds a third of all texts is spread over ranges."""
    d = df.select(*keys, order, text_col)
    d = running_before(d, keys, [order], F.length(text_col) + 1, "_before", ranges)
    d = d.withColumn("chunk_no", F.floor(F.col("_before") / size).cast("int"))
    g = d.groupBy(*keys, "chunk_no").agg(F.array_sort(F.collect_list(F.struct(
        F.col(order).alias("o"), F.col(text_col).alias("t")))).alias("_l"))
    return g.select(*keys, "chunk_no", F.size("_l").alias("n_texts"),
                    F.array_join(F.transform("_l", lambda e: e["t"]), " ").alias("chunk_text"))


def same_day_text(df: DataFrame, keys: Sequence[str], order: str, text_col: str = "text") -> DataFrame:
    """All texts of a key (e.g. asset, date) joined by a space in ``order``."""
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"),
                                                                    F.col(text_col).alias("t")))).alias("_l"))
    return g.select(*keys, F.array_join(F.transform("_l", lambda e: e["t"]), " ").alias("day_text"),
                    F.size("_l").alias("n_texts"))
