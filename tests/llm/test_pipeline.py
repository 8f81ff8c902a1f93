"""The pipeline's stages keep what they should, on the smallest tables and on awkward rows."""

import collections

import corpus_pipeline
from llm.cases import LOW, documents
from pyspark.sql import functions as F


def test_run(spark, data):
    out = corpus_pipeline.run(spark, data).toPandas()
    docs = spark.read.parquet(f"{data}/documents.parquet").toPandas()
    assert 0.5 * len(docs) < len(out) < len(docs) and out["doc_id"].is_unique
    text = docs.set_index("doc_id")["text"].str.translate(LOW)
    assert text[out["doc_id"]].is_unique


def test_stages_keep_the_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, data).columns == docs.columns


def test_exact_stage_keeps_one_of_each(spark, data):
    docs = documents(spark)
    kept = [(r["doc_id"], (r["text"] or "").translate(LOW)) for r in corpus_pipeline.exact(spark, docs, data).collect()]
    every = collections.defaultdict(list)
    for r in docs.collect():
        every[(r["text"] or "").translate(LOW)].append(r["doc_id"])
    assert sorted(t for _, t in kept) == sorted(every)
    assert all(i == max((x for x in every[t] if x is not None), default=None) for i, t in kept)


def test_other_stages_take_awkward_rows(spark, data):
    docs = documents(spark)
    for stage in (corpus_pipeline.good, corpus_pipeline.near, corpus_pipeline.decontaminate, corpus_pipeline.mix):
        assert stage(spark, docs, data).count() <= docs.count()
    assert corpus_pipeline.near(spark, docs.where(F.lit(False)), data).count() == 0
