from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from lamina.llm import langid, mixing, secrets, simhash
from lamina.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages_do_what_their_operators_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start = docs
    for (name, stage), operator in zip(corpus_pipeline.STAGES[:4], (langid, simhash, secrets, mixing), strict=True):
        out = written(stage(spark, docs, SF), name)
        assert out.columns == start.columns, name
        if operator is simhash:
            kept = {r.doc_id for r in out.collect()}
            found = simhash.near_texts(docs).collect()
            assert kept == {r.component_id for r in found} and out.count() == len(kept)
        elif operator is secrets:
            assert out.count() == docs.count() and secrets.scan(out).where("size(spans) > 0").count() == 0
        elif operator is mixing:
            before = docs
            taken = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
            assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {d: c for d, c in taken.items() if c}
        docs = out
    sources = docs.groupBy("source").agg(F.sum(mixing.words(F.col("text"))).alias("n")).collect()
    assert {r.source: r.n for r in sources} == {r.source: r.n for r in mixing.mix(before).groupBy("source").agg(F.sum("taken").alias("n")).collect() if r.n}
    last = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").distinct().collect()}


def test_odd_rows_go_through(spark, odd, nothing):
    for rows in (odd, nothing):
        docs = rows
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, SF), name)
        assert "sequence_id" in docs.columns and (docs.count() > 0) == (rows is not nothing)
