"""Mixing sources to target weights by Poisson replication.

Method.  A source's size is the UTF-8 bytes of its texts, counted over all rows.  With a budget (the
size of the mixture, by default the size of the input) and the target weights, source ``s`` has the
mean repetition rate ``rate_s = budget * weight_s / size_s``.  Each document draws a uniform number
from a seeded hash of its id and text and inverts the Poisson distribution of that mean: its count is
the number of entries of the distribution function that the draw reaches.  Beyond MAX_RATE it is the sum
of that many independent draws of equal means of at most PART_RATE (a sum of Poisson numbers is one of the
summed mean; the DuckDB twin stops at MAX_RATE there).  The document is exploded
by its count and every copy gets a hashed position; rows are dealt out by that position and
sorted by it, which shuffles the mixture globally.  No row is sampled beyond what the draw decides, and
a rerun (or a task that runs again after a lost executor) gives the same mixture.

Weights: by default ``size_s ** TEMPERATURE``, normalised, which lifts small sources; a mapping
``{source: weight}`` sets them outright (sources it lacks get weight 0).

Defined results: null texts count 0 bytes and are drawn like others; a null source is a source
of its own (key ``None`` in a mapping); a source without any bytes has rate 0; rows with equal id and
text share their draw but not their positions' copy numbers; an empty table gives an empty mixture.
All columns of the input are kept as they are; where it has a column ``mix_copy`` or ``mix_position`` already, the new one
gets underscores behind its name.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from textsignal.llm.common import stash

SEED = 20240607
TEMPERATURE = 0.7
#: A rate above this would need a table of more entries than a row should carry.
MAX_RATE = 100_000.0
#: The largest mean of the draws that such a rate is the sum of.
PART_RATE = 1_000.0
#: The rates are broadcast below this many sources; beyond, both sides are shuffled by source and salt.
BROADCAST_SOURCES = 10_000
SALTS = 32


def source_key(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


def rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, budget: float | None = None,
          temperature: float = TEMPERATURE, text: str = "text", source: str = "source") -> DataFrame:
    """(mix_source, size, weight, rate): one row per source, from one partial aggregate over all rows."""
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    per = docs.groupBy(source_key(source).alias("mix_source")).agg(F.sum(size).alias("size"))
    if weights is None:
        raw = F.when(F.col("size") > 0, F.pow(F.col("size").cast("double"), F.lit(temperature))).otherwise(F.lit(0.0))
    else:
        if any(w < 0 or not math.isfinite(w) for w in weights.values()):
            raise ValueError("weights must be finite and not negative")
        raw = F.lit(0.0)
        for name, w in weights.items():
            raw = F.when(F.col("mix_source") == ("null" if name is None else f"={name}"), F.lit(float(w))).otherwise(raw)
    per = per.withColumn("raw", raw)
    per = stash(per, "mixing-sources")   # one row per source: the scan is not repeated for the totals
    raw_total, size_total = per.agg(F.sum("raw"), F.sum("size")).first()
    aim = F.lit(float(budget if budget is not None else size_total or 0))
    weight = F.col("raw") / F.lit(raw_total) if raw_total else F.lit(0.0)
    rate = F.when(F.col("size") > 0, aim * weight / F.col("size")).otherwise(F.lit(0.0))
    return per.select("mix_source", "size", weight.alias("weight"), rate.alias("rate"))


def distribution(rate: Column) -> Column:
    """The Poisson distribution function of ``rate`` as an array, up to where it is 1 for any draw."""
    top = F.ceil(rate + 10.0 * F.sqrt(rate) + 25.0).cast("int")
    logs = F.aggregate(
        F.sequence(F.lit(0), top), F.struct(F.lit(0.0).alias("f"), F.lit(0.0).alias("c"), F.array().cast("array<double>").alias("a")),
        lambda s, k: _step(s, k, rate), lambda s: s["a"])
    return F.when(rate > 0, logs).otherwise(F.array(F.lit(1.0)))


def _step(s: Column, k: Column, rate: Column) -> Column:
    f = s["f"] + F.when(k > 0, F.log(F.greatest(k, F.lit(1)).cast("double"))).otherwise(F.lit(0.0))
    c = s["c"] + F.exp(k * F.log(rate) - rate - f)
    return F.struct(f.alias("f"), c.alias("c"), F.concat(s["a"], F.array(c)).alias("a"))


def unit(*parts: Column) -> Column:
    """A uniform number in [0, 1) from the first 13 hex digits (52 bits) of an md5 hash."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(2 ** 52)


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, budget: float | None = None,
        temperature: float = TEMPERATURE, seed: int = SEED, doc_id: str = "doc_id", text: str = "text",
        source: str = "source", broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """The shuffled mixture: the input's columns, ``mix_copy`` (from 0) and ``mix_position`` (a hash)."""
    table = rates(docs, weights, budget, temperature, text, source)
    parts = F.when(F.col("rate") > MAX_RATE, F.ceil(F.col("rate") / PART_RATE)).otherwise(F.lit(1)).cast("int")
    table = table.withColumn("mix_parts", parts).select(
        "mix_source", "mix_parts", distribution(F.col("rate") / F.col("mix_parts")).alias("mix_cdf"))
    id_ = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    d = docs.select(F.struct("*").alias("row"), source_key(source).alias("mix_source"), id_.alias("mix_id"),
                    F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("mix_draw"))
    if table.limit(broadcast_sources + 1).count() <= broadcast_sources:
        d = d.join(F.broadcast(table), "mix_source")
    else:
        d = d.withColumn("mix_salt", F.pmod(F.hash("mix_draw"), F.lit(SALTS)))
        salted = table.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        d = d.join(salted, ["mix_source", "mix_salt"]).drop("mix_salt")
    u = unit(F.lit(seed), F.col("mix_id"), F.col("mix_draw"))
    reached = lambda u: F.size(F.filter("mix_cdf", lambda c: c <= u))
    more = F.aggregate(F.sequence(F.lit(2), F.col("mix_parts")), F.lit(0), lambda n, k: n + reached(
        unit(F.lit(seed), F.col("mix_id"), F.col("mix_draw"), F.lit("part"), k)))
    d = d.withColumn("mix_u", u).withColumn("mix_count", reached(F.col("mix_u")) + F.when(
        F.col("mix_parts") > 1, more).otherwise(F.lit(0))).select("row", "mix_id", "mix_draw", "mix_count")
    d = d.filter("mix_count > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("mix_count") - 1)))
    position = F.md5(F.concat_ws("|", F.lit("position"), F.lit(seed), F.col("mix_id"), F.col("mix_draw"), F.col("mix_copy")))
    d = d.select("row", "mix_copy", position.alias("mix_position"))
    d = d.repartition("mix_position").sortWithinPartitions("mix_position")
    new = [c + "_" * next(i for i in range(len(docs.columns) + 1) if c + "_" * i not in docs.columns) for c in ("mix_copy", "mix_position")]
    return d.select("row.*", F.col("mix_copy").alias(new[0]), F.col("mix_position").alias(new[1]))
