"""The pipeline: stages in order, columns kept, and the result of a plain run."""

import brute
from pyspark.sql.types import StructType

import corpus_pipeline
from test_operators import SCHEMA, corpus  # noqa: F401
from textsignal.llm import op10_secrets, op1_mixing, op7_sentencepiece, op8_quality
from textsignal.llm.pieces import default_model


def test_stages(spark, tmp_path):
    rows = [r[:5] for r in corpus()]
    names = [f.name for f in SCHEMA][:5]
    spark.createDataFrame(rows, StructType(SCHEMA.fields[:5])).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {(r.doc_id, r.text) for r in op8_quality.filter_documents(docs).collect()}
    left = [r for r in rows if (r[0], r[1]) in kept]
    one = {}
    for r, (_, n, c) in zip(left, brute.jaccard_components([(r[0], r[1]) for r in left])):
        if n and r[0] == c:
            one[c] = r
    forest = op10_secrets.trained()

    def masked(text):
        for s, e, score in reversed(op10_secrets.scan([text], forest)[0]):
            if score >= op10_secrets.THRESHOLD:
                text = text[:s] + op10_secrets.MASK + text[e:]
        return text

    clean = [(r[0], masked(r[1]), *r[2:4], len(masked(r[1]))) for r in one.values()]
    mixture = op1_mixing.mix(spark.createDataFrame(clean, "doc_id long, text string, lang string, source string, n_chars long"))
    e = op7_sentencepiece.encoder(default_model())
    want = sorted((r.doc_id, len(e.encode(r.text)[0]) // 4) for r in mixture.collect())
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.n_pieces) for r in out.collect()) == want
    assert out.filter("not round_trip").count() == 0
    stage = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, str(tmp_path))
        assert stage.columns == names
