"""The training-data queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat_format, decontam, exact_dedup, license_scan, lm_score, mixing, near_dedup, quality, suffix_dedup, warc_revisit
from tessera.llm.staging import table

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    return chat_format.maximal_conversations(table(spark, sf_dir, "conversations"))


def page_records(pages: DataFrame) -> DataFrame:
    """Crawl records made from ``pages``: each page's full response and, a day later, a not-modified revisit of its URL.

    The first 12 hex digits of the page's SHA-256 are the entity tag. Every seventh revisit names another one, every
    fifth only the payload digest. Times are hours of the page's number.
    """
    n = F.col("page_id")
    digest = F.sha2(F.coalesce("html", F.lit("")), 256)
    tag = F.substring(digest, 1, 12)
    shared = [F.col("url"), digest.alias("digest")]
    full = pages.select((n * 2).alias("record_id"), (n * 3600).alias("time"), F.lit("response").alias("type"), tag.alias("etag"), F.lit(None).cast("string").alias("last_modified"), *shared, F.create_map(F.lit("ETag"), tag, F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), (n * 3600).cast("string")).alias("headers"))
    own = F.when(n % 5 == 0, F.lit(None)).when(n % 7 == 0, F.lit("other")).otherwise(tag)
    again = pages.select((n * 2 + 1).alias("record_id"), (n * 3600 + 86400).alias("time"), F.lit("revisit").alias("type"), own.alias("etag"), F.lit(None).cast("string").alias("last_modified"), *shared, F.create_map(F.lit("Date"), (n * 3600 + 86400).cast("string"), F.lit("Set-Cookie"), F.lit("c")).alias("headers"))
    return full.unionByName(again)


def op2_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisits with the response they stand for; the merged headers as sorted text."""
    found = warc_revisit.resolve_revisits(page_records(table(spark, sf_dir, "pages")))
    headers = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return found.withColumn("headers", headers)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), width=2).select("doc_id", "n_shingles", "component_id", "kept")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("detections")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_report(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_warc_revisit": op2_warc_revisit,
    "op3_mix_sources": op3_mix_sources,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_decontaminate": op8_decontaminate,
    "op9_lm_score": op9_lm_score,
    "op10_suffix_dedup": op10_suffix_dedup,
}

_SIZES = r"SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM documents"

ORACLES = {
    "op1_chat_format": r"""
WITH c AS (SELECT conv_id, count(*) AS n, list(coalesce(role, 'unknown') || chr(1) || coalesce(text, '') ORDER BY turn NULLS FIRST, role, text) AS l,
                  string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered
           FROM conversations GROUP BY conv_id),
g AS (SELECT l, n, rendered, min(conv_id) AS conv_id, count(*) AS copies FROM c GROUP BY l, n, rendered)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, CAST(copies AS BIGINT) AS copies, rendered
FROM g WHERE NOT EXISTS (SELECT 1 FROM g b WHERE b.n > g.n AND b.l[1:g.n] = g.l)""",
    "op2_warc_revisit": r"""
WITH u AS (SELECT page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM pages),
h AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*', 0)), '^www[.]', ''), ':(80|443)$', '') AS host,
             regexp_replace(regexp_extract(u, '^[^/?]*(.*)$', 1), '([?&])(utm_[a-z]+|ref)=[^&]*', '\1', 'g') AS rest FROM u),
k AS (SELECT page_id, sha256(coalesce(html, '')) AS digest,
             host || regexp_replace(regexp_replace(regexp_replace(regexp_replace(rest, '&&+', '&', 'g'), '[?]&', '?', 'g'), '[?&]+$', ''), '/+$', '') AS canonical FROM h),
full_ AS (SELECT canonical, page_id * 3600 AS t, page_id * 2 AS response_id, digest, substr(digest, 1, 12) AS tag FROM k),
again AS (SELECT canonical, page_id * 3600 + 86400 AS t, page_id * 2 + 1 AS record_id, digest,
                 CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 7 = 0 THEN 'other' ELSE substr(digest, 1, 12) END AS tag FROM k),
j AS (SELECT a.*, f.response_id, f.digest AS stored, f.tag AS stored_tag, f.t AS stored_t,
             row_number() OVER (PARTITION BY a.record_id ORDER BY f.t DESC NULLS LAST, f.response_id DESC) AS r
      FROM again a LEFT JOIN full_ f ON a.canonical = f.canonical AND f.t <= a.t),
s AS (SELECT *, CASE WHEN response_id IS NULL THEN 'orphan' WHEN coalesce(tag = stored_tag, tag IS NULL AND digest = stored) THEN 'resolved' ELSE 'mismatch' END AS status FROM j WHERE r = 1)
SELECT record_id, canonical, response_id, status, CASE WHEN status = 'resolved' THEN stored ELSE digest END AS digest,
       CASE WHEN status = 'resolved' THEN 'Content-Type=text/html;Date=' || t || ';ETag=' || stored_tag ELSE 'Date=' || t || ';Set-Cookie=c' END AS headers FROM s""",
    "op3_mix_sources": rf"""
WITH s AS ({_SIZES}),
p AS (SELECT source, sum(size)::BIGINT AS total FROM s GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM p),
w AS (SELECT *, (no - 1) % 3 + 1 AS weight, total * 3 AS cap FROM n),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, no) AS pos FROM w),
f AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
             sum(weight) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remaining,
             sum(total) OVER () AS every FROM o),
l AS (SELECT *, CAST(every - filled AS DOUBLE) / CAST(remaining AS DOUBLE) AS level FROM f),
r AS (SELECT *, arg_min(level, pos) FILTER (cap > level * weight) OVER () AS base FROM l),
t AS (SELECT source, total, CASE WHEN cap > level * weight THEN base * weight ELSE CAST(cap AS DOUBLE) END AS target FROM r),
j AS (SELECT s.*, t.total, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
             coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, total AS source_size, target,
       CAST(CASE WHEN total > 0 THEN budget // total * size + greatest(0, least(size, budget - budget // total * total - before)) ELSE 0 END AS BIGINT) AS taken
FROM j""",
    "op6_exact_dedup": f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{_UP}', '{_LOW}') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256 FROM t""",
    "op8_decontaminate": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
x AS (SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS win, len(w[i:i + 9]) AS n
      FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM x),
g AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
h AS (SELECT g.doc_id, g.i, g.n, x.item FROM g JOIN x ON g.win = x.win AND g.n = x.n),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
}
