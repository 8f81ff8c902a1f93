"""Ids of other types, repeated rows, and tables without rows, for every operator and the whole pipeline."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from llm.cases import documents, empty
from tessera.llm import chat_format, decontam, exact_dedup, license_scan, lm_score, mixing, near_dedup, quality, suffix_dedup, warc_revisit


def test_ids_that_are_not_whole_numbers_are_refused(spark):
    docs = spark.createDataFrame([("a", "one two", "s")], "doc_id string, text string, source string")
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    calls = [near_dedup.near_groups, near_dedup.drop_near, exact_dedup.exact_groups, license_scan.scan_licenses, lm_score.score_documents, suffix_dedup.repeat_report, mixing.mix_sources, lambda d: decontam.contamination_report(d, bench), lambda d: quality.score_quality(d, labels)]
    for call in calls:
        with pytest.raises(TypeError, match="whole numbers"):
            call(docs)
    with pytest.raises(TypeError, match="whole numbers"):
        chat_format.maximal_conversations(spark.createDataFrame([("a", 1, "user", "x")], "conv_id string, turn int, role string, text string"))


def test_repeated_turns_and_records(spark):
    turns = [(1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "bot", "b")]
    found = chat_format.maximal_conversations(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")).collect()
    assert [(r["conv_id"], r["n_turns"]) for r in found] == [(3, 3)]
    schema = "record_id long, url string, time long, type string, etag string, last_modified string, digest string, headers map<string,string>"
    records = [(1, "http://a/x", 1, "response", "t", None, "d", {"ETag": "t"})] * 2 + [(2, "http://a/x", 5, "revisit", "t", None, "d", None)] * 3
    again = warc_revisit.resolve_revisits(spark.createDataFrame(records, schema)).collect()
    assert [(r["record_id"], r["response_id"], r["status"]) for r in again] == [(2, 1, "resolved")] * 3


def test_pipeline_on_empty_tables(spark, tmp_path):
    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages_take_columns_with_helper_names(spark, data):
    docs = documents(spark)
    for name in ("_near_id", "_near_hash", "_gone", "_again", "_digest", "_stays_id", "_NEAR_HASH_", "_text", "_hash", "_rid"):
        docs = docs.withColumn(name, F.lit("x"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns and out.count() <= docs.count()
