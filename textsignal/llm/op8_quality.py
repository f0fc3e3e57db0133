"""Quality rules with adaptive thresholds, in DataFrame expressions only.

Method.  Every document gets a few ratios (symbols, mean word length, repeated lines).  Per (language, source) group each ratio is summarised by a *mergeable quantile sketch*: a
histogram over fixed logarithmic buckets with a bounded relative error.  Sketches merge by adding
bucket counts, so the partial aggregates of all tasks combine in any order to the same sketch, and
a group that holds a third of all rows is pre-reduced in each task.  The quartiles read from the
sketch give the group's fences ``q75 + FENCE * max(q75 - q25, floor)`` (and the mirror image below
for the mean word length); they replace fixed cut-offs.  The fences are joined back to the
documents, and a document outside any of its group's fences is rejected.  The fixed base rules
(too few words, too much repetition) always reject.

Defined results: a null or blank text has no words, all counts 0, and fails the base rules.  Null
language or source is a group of its own.  Repeated rows are judged one by one; ids may repeat or be
null.  An empty table gives an empty result.  Other columns are ignored by the query and kept by
``filter_documents``.  Windows of eight words are compared by 64-bit hashes of word hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textsignal.llm.common import WORD, stash, text_or_empty

MIN_WORDS = 20          # fixed by the contract
MAX_REPEAT_PERCENT = 30  # fixed by the contract
WINDOW = 8               # fixed by the contract
SYMBOLS = "[#*$%&|<>]"   # fixed by the contract
PROBE = (0, 3, 7)        # offsets in a window that are compared before whole windows

#: Two-sided fence of the quartiles, in inter-quartile ranges.
FENCE = 3.0
#: Relative width of a sketch bucket, and the smallest value that is told from zero.
GAMMA = 1.02
SMALLEST = 1e-4
#: Ratio -> (smallest inter-quartile range that a fence assumes, has it a lower fence).
RATIOS = {"symbol_share": (0.02, False), "mean_word": (0.5, True), "dup_line_share": (0.15, False)}


def _gram(words: str, offsets: range | tuple[int, ...]) -> Column:
    """At each position that a whole window follows, a hash of the words at these offsets."""
    every = F.transform(words, lambda x, i: F.xxhash64(x, *[F.get(words, i + k) for k in offsets if k]))
    return F.slice(every, 1, F.size(words) - (WINDOW - 1))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus the base counts, prefixed ``m_`` until the caller selects them."""
    t, n = F.col("m_text"), F.col("m_n_words")
    d = docs.withColumn("m_text", text_or_empty(text))
    d = d.withColumn("m_words", F.array_remove(F.split(t, r"[\x20\x09-\x0D]+", -1), ""))
    d = d.withColumn("m_n_words", F.size("m_words").cast("long")).withColumn(
        "m_word_chars", F.char_length(F.array_join("m_words", "")).cast("long")).withColumn(
        "m_h", F.transform("m_words", lambda w: F.xxhash64(w))).drop("m_words")
    # Equal windows agree in a few of their words.  Those are compared first: few documents have such a
    # pair, and only they pay for the windows, only true repeats for the sort.
    d = d.withColumn("m_g", F.when(n > WINDOW, _gram("m_h", PROBE))
                     .otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("m_h", F.when(F.size("m_g") > F.size(F.array_distinct("m_g")), F.col("m_h"))).drop("m_g")
    d = d.withColumn("m_w", F.when(F.col("m_h").isNotNull(),
                                   _gram("m_h", range(WINDOW)))).drop("m_h")
    d = d.withColumn("m_sorted", F.when(
        F.col("m_w").isNotNull() & (F.size("m_w") > F.size(F.array_distinct("m_w"))),
        F.sort_array(F.transform("m_w", lambda h, i: F.struct(h.alias("h"), i.alias("p")))))).drop("m_w")
    d = d.withColumn("m_pos", F.when(F.col("m_sorted").isNotNull(), F.sort_array(F.transform(
        F.filter("m_sorted", lambda s, i: (s["h"] == F.get("m_sorted", i - 1)["h"])
                 | (s["h"] == F.get("m_sorted", i + 1)["h"])), lambda s: s["p"])))).drop("m_sorted")
    covered = F.aggregate(
        "m_pos", F.struct(F.lit(0).alias("e"), F.lit(0).alias("n")),
        lambda a, p: F.struct((p + WINDOW).alias("e"),
                              (a["n"] + p + WINDOW - F.greatest(a["e"], p)).alias("n")), lambda a: a["n"])
    d = d.withColumn("m_n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("m_pos")
    d = d.withColumn("m_lines", F.split(t, "\n", -1)).withColumn("m_n_lines", F.size("m_lines"))
    worded = F.filter("m_lines", lambda x: x.rlike(WORD))
    d = d.withColumn("m_lines", F.when(F.col("m_n_lines") > F.size(F.array_distinct("m_lines")), worded))
    return (d.withColumn("m_n_dup_lines", F.coalesce(F.size("m_lines") - F.size(F.array_distinct("m_lines")), F.lit(0)).cast("long"))
            .drop("m_lines")
            .withColumn("m_n_symbols", F.regexp_count(t, F.lit(SYMBOLS)).cast("long")).drop("m_text")
            .withColumn("m_base_failed", (n < MIN_WORDS) | (100 * F.col("m_n_repeat_words") > MAX_REPEAT_PERCENT * n)))


def _ratios() -> dict[str, Column]:
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {"symbol_share": share("m_n_symbols", "m_word_chars"),
            "mean_word": share("m_word_chars", "m_n_words"), "dup_line_share": share("m_n_dup_lines", "m_n_lines")}


def sketch(measured: DataFrame, group: list[str]) -> DataFrame:
    """Per group and ratio the bucket counts of all rows with words: (group, ratio, bucket, n)."""
    bucket = lambda x: F.when(x < SMALLEST, F.lit(-1)).otherwise(
        F.floor(F.log(x / SMALLEST) / F.log(F.lit(GAMMA))).cast("int"))
    rows = measured.filter(F.col("m_n_words") > 0).select(*group, F.inline(F.array(*[
        F.struct(F.lit(name).alias("ratio"), bucket(x).alias("bucket")) for name, x in _ratios().items()])))
    return rows.groupBy(*group, "ratio", "bucket").agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketches: DataFrame, group: list[str]) -> DataFrame:
    """Lower and upper quartile of every (group, ratio), from the running bucket counts.  A window
    sees the buckets of one ratio in one group: a few hundred rows however large the group is."""
    w = Window.partitionBy(*group, "ratio").orderBy("bucket")
    value = F.when(F.col("bucket") < 0, F.lit(0.0)).otherwise(
        F.lit(SMALLEST) * F.pow(F.lit(GAMMA), F.col("bucket") + 0.5))
    run = sketches.withColumn("upto", F.sum("n").over(w)).withColumn(
        "total", F.sum("n").over(Window.partitionBy(*group, "ratio"))).withColumn("value", value)
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("value")))
    return run.groupBy(*group, "ratio").agg(at(0.25).alias("q25"), at(0.75).alias("q75"))


def fences(sketches: DataFrame, group: list[str]) -> DataFrame:
    """One row per group: an upper fence for each ratio, and a lower one where it has one."""
    q = quartiles(sketches, group)
    cols = []
    for name, (floor, lower) in RATIOS.items():
        mine = F.col("ratio") == name
        spread = FENCE * F.greatest(F.col("q75") - F.col("q25"), F.lit(floor))
        cols.append(F.max(F.when(mine, F.col("q75") + spread)).alias(f"hi_{name}"))
        if lower:
            cols.append(F.max(F.when(mine, F.col("q25") - spread)).alias(f"lo_{name}"))
    return q.groupBy(*group).agg(*cols)


def judge(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``measured`` plus ``m_kept``.  The group's few fences reach its rows by an equi-join on
    (language, source); Spark broadcasts them by measured size or splits the large groups."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    group = ["m_lang", "m_source"]
    m = measured.withColumn("m_lang", key(lang)).withColumn("m_source", key(source))
    limits = fences(sketch(m, group), group)
    out = m.join(limits, group, "left")
    outside = F.lit(False)
    for name, x in _ratios().items():
        outside = outside | F.coalesce(x > F.col(f"hi_{name}"), F.lit(False))
        if RATIOS[name][1]:
            outside = outside | F.coalesce(x < F.col(f"lo_{name}"), F.lit(False))
    return out.withColumn("m_kept", ~F.col("m_base_failed") & ~outside)


def quality_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
                   source: str = "source") -> DataFrame:
    """One row per document: counts, the base verdict and the adaptive verdict."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"),
                      F.col(source).alias("source"))
    m = stash(measure(own).drop("text"), "quality-measures")
    return judge(m).select("doc_id", *[F.col(f"m_{c}").alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def filter_documents(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The kept documents, with exactly the columns they came with: rows are carried whole beside the measures, so their names
    can't clash with any of this module."""
    own = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    m = stash(measure(own).drop("text"), "quality-documents")
    return judge(m).filter("m_kept").select("row.*")
