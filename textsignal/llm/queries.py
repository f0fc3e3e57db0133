"""Registered queries of the operators (``opN_<name>``) and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textsignal.llm import (op10_secrets, op11_packing, op12_ranked_search, op13_whitening, op1_mixing, op2_lm_scoring, op3_pii, op4_token_counts, op5_suffix_dedup, op6_jaccard_join,
                            op7_sentencepiece, op8_quality, op9_ann)
from textsignal.llm.common import documents
from textsignal.sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole corpus mixed to tempered source weights, at the size of the input."""
    return op1_mixing.mix(documents(spark, sf_dir))


@query
def op2_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attention-model and baseline scores of every document."""
    return op2_lm_scoring.lm_scores(documents(spark, sf_dir))


@query
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: the fixed patterns and the spans that the CRF adds."""
    return op3_pii.personal_data(documents(spark, sf_dir))


@query
def op4_transducer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document by the compiled transducer."""
    return op4_token_counts.token_counts(documents(spark, sf_dir))


@query
def op5_suffix_dedup_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the bytes of repeated 200-byte strings."""
    return op5_suffix_dedup.dedup(documents(spark, sf_dir))


@query
def op6_jaccard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document in the exact shingle join."""
    return op6_jaccard_join.jaccard_components(documents(spark, sf_dir))


@query
def op7_sentencepiece_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-scored pieces of every document, decoded again."""
    return op7_sentencepiece.encode(documents(spark, sf_dir))


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the adaptive thresholds for every document."""
    return op8_quality.quality_report(documents(spark, sf_dir))


@query
def op9_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows found for every embedding whose id is divisible by 50."""
    vectors = load(spark, sf_dir, "embeddings")
    return op9_ann.search(vectors, vectors.filter(f"vec_id % {op9_ann.EVERY} = 0"))


@query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates and secrets of every document, as the forest judges them."""
    return op10_secrets.secret_report(documents(spark, sf_dir))


@query
def op11_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of at most 4096 tokens."""
    return op11_packing.pack(documents(spark, sf_dir))


@query
def op12_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item by impact scores."""
    return op12_ranked_search.rank(documents(spark, sf_dir), load(spark, sf_dir, "benchmark"))


@query
def op13_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 16 whitened components of every embedding."""
    return op13_whitening.whiten(load(spark, sf_dir, "embeddings"))


_t = op1_mixing.TEMPERATURE
ORACLE["op1_mixing_sources"] = f"""
WITH size AS (SELECT source, sum(coalesce(octet_length(encode(text)), 0))::DOUBLE AS size FROM documents GROUP BY source),
rated AS (SELECT source, CASE WHEN size > 0 THEN least((SELECT sum(size) FROM size) * (pow(size, {_t}) / (SELECT sum(pow(size, {_t})) FROM size WHERE size > 0)) / size, {op1_mixing.MAX_RATE}) ELSE 0 END AS rate FROM size),
term AS (SELECT source, rate, k, sum(CASE WHEN k > 0 THEN ln(k) ELSE 0 END) OVER (PARTITION BY source ORDER BY k) AS f
  FROM rated, unnest(range(0, ceil(rate + 10 * sqrt(rate) + 25)::BIGINT + 1)) AS u(k) WHERE rate > 0),
cdf AS (SELECT source, list(c ORDER BY k) AS cdf FROM (
  SELECT source, k, sum(exp(k * ln(rate) - rate - f)) OVER (PARTITION BY source ORDER BY k) AS c FROM term) GROUP BY source),
drawn AS (SELECT d.*, md5(coalesce(d.text, '')) AS h, cdf FROM documents d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source),
counted AS (SELECT *, len(list_filter(cdf, lambda c: c <= u)) AS n FROM (
  SELECT *, ('0x' || substr(md5('{op1_mixing.SEED}|' || coalesce(doc_id::VARCHAR, 'null') || '|' || h), 1, 13))::BIGINT::DOUBLE / {2 ** 52} AS u FROM drawn))
SELECT doc_id, text, lang, source, n_chars, j::INTEGER AS mix_copy,
  md5('position|{op1_mixing.SEED}|' || coalesce(doc_id::VARCHAR, 'null') || '|' || h || '|' || j) AS mix_position
FROM counted, unnest(range(0, n)) AS u(j)
"""


def _quality_sql(table: str = "documents") -> str:
    q = op8_quality
    ratios = {"symbol_share": "CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END",
              "mean_word": "CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END",
              "dup_line_share": "CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END"}
    long = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS ratio, {r} AS x FROM shares WHERE n_words > 0" for r in ratios)
    checks = []
    for r, (floor, lower) in q.RATIOS.items():
        spread = f"{q.FENCE} * greatest(f.q75 - f.q25, {floor})"
        out = f"s.{r} > f.q75 + {spread}" + (f" OR s.{r} < f.q25 - {spread}" if lower else "")
        checks.append(f"(f.ratio = '{r}' AND ({out}))")
    word = r"[^\x20\x09-\x0D]+"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, lang, source FROM {table}),
w AS (SELECT *, regexp_extract_all(t, '{word}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS ls FROM d),
win AS (SELECT rid, i, list_slice(ws, i, i + {q.WINDOW - 1}) AS g FROM w, unnest(range(1, len(ws) - {q.WINDOW - 2})) AS u(i) WHERE len(ws) > {q.WINDOW}),
dup AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cov AS (SELECT rid, sum(least({q.WINDOW}, coalesce(nxt - i, {q.WINDOW}))) AS n FROM (
  SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM dup) GROUP BY rid),
counts AS (SELECT w.rid, doc_id, lang, source, len(ws)::BIGINT AS n_words,
  coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '{q.SYMBOLS}'))::BIGINT AS n_symbols,
  len(string_split(t, chr(10))) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov USING (rid)),
shares AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in ratios.items())} FROM counts),
sketch AS (SELECT lang, source, ratio, CASE WHEN x < {q.SMALLEST} THEN -1 ELSE floor(ln(x / {q.SMALLEST}) / ln({q.GAMMA}))::INTEGER END AS bucket, count(*) AS n
  FROM ({long}) GROUP BY ALL),
run AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, ratio ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lang, source, ratio) AS total,
  CASE WHEN bucket < 0 THEN 0 ELSE {q.SMALLEST} * pow({q.GAMMA}, bucket + 0.5) END AS v FROM sketch),
f AS (SELECT lang, source, ratio, min(v) FILTER (upto >= 0.25 * total) AS q25, min(v) FILTER (upto >= 0.75 * total) AS q75 FROM run GROUP BY ALL),
outside AS (SELECT DISTINCT s.rid FROM shares s JOIN f ON s.lang IS NOT DISTINCT FROM f.lang AND s.source IS NOT DISTINCT FROM f.source WHERE {' OR '.join(checks)}),
judged AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rid NOT IN (SELECT rid FROM outside) AS kept FROM judged
"""


ORACLE["op8_quality_rules"] = _quality_sql()

_terms = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
ORACLE["op12_norm_buckets"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_terms} AS ts FROM documents WHERE text IS NOT NULL),
dn AS (SELECT rid, doc_id, ts, len(ts)::BIGINT AS n FROM d WHERE len(ts) > 0),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM dn),
f AS (SELECT rid, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT rid, doc_id, n, unnest(ts) AS term FROM dn) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, total GROUP BY term),
item AS (SELECT item_id, unnest(list_distinct(ts)) AS term FROM (SELECT DISTINCT item_id, {_terms} AS ts FROM benchmark WHERE text IS NOT NULL)),
scored AS (SELECT item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM item JOIN f USING (term) JOIN w USING (term), total GROUP BY item_id, rid, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, rid)::INTEGER AS rank, doc_id, score FROM scored
WHERE score > 0 QUALIFY rank <= {op12_ranked_search.K}
"""
