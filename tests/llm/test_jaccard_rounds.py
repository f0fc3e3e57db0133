"""Rounds of the Jaccard join: members of a region stay together, and sketches are close bounds."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from textsignal.llm import common, op6_jaccard_join as join


def test_members_of_a_region_meet_after_a_join(spark):
    """A join by region that becomes a broadcast one at run time must not leave the members of a region in several tasks."""
    sets = np.sort(np.random.default_rng(1).integers(0, 2 ** 63, 400).astype(np.uint64))
    raw = join.sketch(sets)
    rows = [(region, unit, 400, unit, bytearray(raw)) for unit in range(24) for region in range(6)]
    # rows of an RDD: their size is unknown before they are read, so that the join is planned as a sort-merge join
    m = spark.createDataFrame(spark.sparkContext.parallelize(rows, 12), "region long, unit long, size long, component long, sketch binary")
    few = spark.createDataFrame(spark.sparkContext.parallelize([(r, 24) for r in range(6)], 3), "region long, n long")
    m = m.join(few, "region").select("region", "unit", "size", "component", "sketch")
    m = m.withColumn("home", F.lit(True)).withColumn("side", F.lit(0))
    found = {(r["a"], r["b"]) for r in join.candidates(m, None).distinct().collect()}
    assert found == {(a, b) for a in range(24) for b in range(a + 1, 24)}


def test_sketches_tell_unlinked_neighbours():
    """Texts that share two thirds of their shingles are no candidates: the bound of their distance of 1/2 is above TAU."""
    random.seed(3)
    words = lambda n: [str(random.random()) for _ in range(n)]
    core = words(400)
    sets = join.shingle_sets([" ".join(core + words(200)) for _ in range(30)])
    k, n = join.unpacked([join.sketch(s) for s in sets]), np.array([len(s) for s in sets])
    d = join.lows(k, n, k, n)
    assert (d[~np.eye(len(sets), dtype=bool)] > 0.35).all() and (np.diag(d) == 0).all()


def test_tasks_hold_few_texts_and_links_fill_few_files(spark, monkeypatch):
    """Whole texts go to Python in small batches, and the session's width is as before; links do not leave a file per task."""
    random.seed(5)
    rows = []
    for i in range(40):
        words = [str(random.random()) for _ in range(60)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:59] + ["end"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    width = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old, seen, files = spark.conf.get(width), {}, {}

    def spy(df, name, *args, **more):
        out = common.stash(df, name, *args, **more)
        seen[name] = more.get("rows")
        files.setdefault(name, len(out.inputFiles()))
        return out

    monkeypatch.setattr(join, "stash", spy)
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")       # as where sets are many
    try:
        found = {r["doc_id"]: r["component_id"] for r in join.jaccard_components(docs).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert found == {i: i - i % 2 for i in range(80)}
    assert {seen[n] for n in ("jaccard-census", "jaccard-regions", "jaccard-sets")} == {common.TEXTS}
    assert files["jaccard-links"] == 1

    def sizes(batches):
        for b in batches:
            yield pd.DataFrame({"n": [len(b)]})

    most = common.stash(spark.range(0, 3500, 1, 1).mapInPandas(sizes, "n long"), "batches", rows=common.TEXTS)
    assert most.agg(F.max("n"), F.sum("n")).first() == (1000, 3500)
    assert spark.conf.get(width) == old
