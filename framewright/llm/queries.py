"""The registered query of each corpus operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import (
    op1_warc,
    op2_class_ngrams,
    op3_decontaminate,
    op4_language,
    op5_repeats,
    op6_near_duplicates,
    op7_url_trust,
    op8_token_files,
    op9_vector_search,
    op10_mixing,
    op11_line_dedup,
    op12_hard_negatives,
    op13_alignment,
)
from framewright.llm.common import table
from framewright.session import shared_path

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def op1_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory, folder = op1_warc.archive(table(spark, sf_dir, "pages"))
    return op1_warc.read_all(directory, folder)


def op2_class_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_class_ngrams.score(table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_decontaminate.find(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_language.identify(table(spark, sf_dir, "documents"))


def op5_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_repeats.remove_repeats(table(spark, sf_dir, "documents"), digests=True)


def op6_near_duplicate_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_url_trust.judge(table(spark, sf_dir, "pages"))


def op8_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    op8_token_files.write_tokens(
        table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER)
    )
    return op8_token_files.token_digests(op8_token_files.read_tokens(spark, path))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_vector_search.top_k(table(spark, sf_dir, "embeddings"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = op10_mixing.plan_mix(table(spark, sf_dir, "documents"))
    each = plan.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return each.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        "copies",
        "shards",
    )


def op11_line_dedup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_line_dedup.line_digests(
        op11_line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    )


def op12_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return op12_hard_negatives.hard_negatives(vectors.withColumn("label", noisy))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_alignment.alignment_counts(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path(TOKENIZER),
        public_tokenizers.path(PIECES),
    )


QUERIES = {
    q.__name__: q
    for q in (
        op1_warc_capture_index,
        op2_class_ngram_scores,
        op3_benchmark_decontamination,
        op4_language_id,
        op5_repeated_strings,
        op6_near_duplicate_components,
        op7_url_filter,
        op8_token_id_files,
        op9_exact_top_k,
        op10_source_mixing,
        op11_line_dedup_counts,
        op12_hard_negative_mining,
        op13_tokenizer_alignment,
    )
}

_OP1_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest
  FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN f.first <> p.page_id OR (p.page_id IS NULL AND f.first IS NOT NULL)
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first IS DISTINCT FROM p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest AND p.n >= 100
"""

_OP9_SQL = """
WITH v AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.id AS query_id, c.id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.vec, c.vec), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM (SELECT DISTINCT id, vec FROM v WHERE id % 50 = 0) q
  JOIN (SELECT DISTINCT id, vec FROM v) c ON q.id <> c.id AND len(q.vec) = len(c.vec)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

_OP11_SQL = r"""
WITH l AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
e AS (
  SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM l),
k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
h AS (
  SELECT key, min(doc_id) AS first,
         count(DISTINCT doc_id) + CAST(bool_or(doc_id IS NULL) AS INTEGER) AS documents
  FROM k WHERE length(key) >= 10 GROUP BY key),
d AS (
  SELECT r, doc_id, place, line, coalesce(documents >= 2 AND first IS DISTINCT FROM doc_id, false) AS dropped
  FROM k LEFT JOIN h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
FROM d GROUP BY r, doc_id
"""

_OP12_SQL = """
WITH v AS MATERIALIZED (
  SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS MATERIALIZED (SELECT row_number() OVER () AS a, * FROM v WHERE id % 50 = 0),
s AS MATERIALIZED (
  SELECT a.a, a.id AS anchor_id, a.label = c.label AS alike, c.id,
         CAST(list_sum(list_transform(list_zip(a.vec, c.vec), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM a JOIN v c ON a.id <> c.id AND len(a.vec) = len(c.vec)),
p AS (
  SELECT a, anchor_id, id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY a ORDER BY score DESC, id) AS place
  FROM s WHERE alike),
n AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.place ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON p.a = s.a AND NOT s.alike AND p.place <= 5
       AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 3
"""

ORACLES = {
    "op9_exact_top_k": _OP9_SQL,
    "op1_warc_capture_index": _OP1_SQL,
    "op11_line_dedup_counts": _OP11_SQL,
    "op12_hard_negative_mining": _OP12_SQL,
}
