"""Corpus pipeline: quality classifier, exact dedup, near dedup, benchmark decontamination, source mixing.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame; all
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, exact_dedup, mixing, near_dedup, quality
from tessera.llm.staging import Staging, fresh, table


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go, row by row."""
    return quality.drop_rejected(docs, table(spark, sf_dir, "labels"))


def without(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of ``docs`` but for those whose id has verdicts (doc_id, kept) and none that keeps it; null ids count as one id."""
    gone, kept = fresh(docs, "_gone"), fresh(docs, "_kept")
    ids = verdicts.groupBy(F.col("doc_id").alias(gone)).agg(F.max("kept").alias(kept)).where(~F.col(kept)).select(gone)
    ids = Staging(docs.sparkSession, "pipeline").put(ids, "gone")
    return docs.join(near_dedup.fitting(ids), docs["doc_id"].eqNullSafe(F.col(gone)), "left_anti")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays; of rows that agree in id and text one stays too."""
    groups = Staging(spark, "pipeline").put(exact_dedup.exact_groups(docs).select("doc_id", "kept", "text_sha256"), "exact")
    again, digest, stays_id, stays_sha = (fresh(docs, x) for x in ("_again", "_digest", "_stays_id", "_stays_sha"))
    repeated = groups.groupBy(F.col("doc_id").alias(again)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(again)
    if repeated.isEmpty():
        return without(docs, groups)
    twice = docs["doc_id"].eqNullSafe(F.col(again))
    single = without(docs.join(repeated, twice, "left_anti"), groups)
    stays = groups.where("kept").select(F.col("doc_id").alias(stays_id), F.col("text_sha256").alias(stays_sha))
    own = F.sha2(F.translate(F.coalesce("text", F.lit("")), _UP, _LOW), 256)
    rest = docs.join(repeated, twice, "left_semi").withColumn(digest, own).dropDuplicates(["doc_id", digest])
    rest = rest.join(stays, F.col("doc_id").eqNullSafe(F.col(stays_id)) & (F.col(digest) == F.col(stays_sha)), "left_semi").drop(digest)
    return single.unionByName(rest)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more) stays, decided row by row."""
    return near_dedup.drop_near(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, row by row."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of the documents that are left."""
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [("quality classifier", good), ("exact dedup", exact), ("near dedup", near), ("benchmark decontamination", decontaminate), ("mixing", mix)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    staging = Staging(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = staging.put(stage(spark, docs, sf_dir), str(i))
        if i:
            staging.drop(str(i - 1))
    return STAGES[-1][1](spark, docs, sf_dir)
