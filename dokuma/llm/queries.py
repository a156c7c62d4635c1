"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dokuma.llm import bands, bpe, decontaminate, divergence, forest, fst, lines, pitman_yor, resample, runs, sharding, suffix, topk
from dokuma.session import table


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, draw and verdict of every document; what nulls, repeats and missing labels do, says resample()."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_seed_and_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the items of which they hold copies; nulls, repeats, short and empty items as in leaks()."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under the law `bytes`; nulls and repeats as in shard_documents()."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 40)


def op4_line_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated runs of every document; nulls, repeats and ties as in line_dedup()."""
    return lines.line_dedup(table(spark, sf_dir, "documents"))


def op5_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every text, learnt from those not held out (a null id is not); nulls and repeats as in score()."""
    return pitman_yor.score(table(spark, sf_dir, "documents"), pitman_yor.held_out_rows(F.col("doc_id")))


def op6_two_tier_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text and their digests; nulls and repeats as in encode_column()."""
    return bpe.encode_column(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op7_interval_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without the strings of 100 bytes that start earlier; nulls, ties and repeats as in removal_digests()."""
    return suffix.removal_digests(table(spark, sf_dir, "documents"))


def op8_transducer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text; nulls, special strings and repeats as in count_tokens()."""
    return fst.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document; nulls, texts without words and repeats as in near_duplicates()."""
    return forest.near_duplicates(table(spark, sf_dir, "documents"))


def op10_branch_and_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best vectors for each vector of an id divisible by 20; nulls, ties, repeats and large numbers as in top_k()."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20)


def op11_baseline_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of the sources of each language, and the terms that set them apart; nulls as in divergence()."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_partition_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document; nulls as in periodic_runs()."""
    return runs.periodic_runs(table(spark, sf_dir, "documents"), plant=True).drop("runs")


def op13_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the compression verdict of every document; nulls as in compression_bands()."""
    return bands.compression_bands(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_importance_resampling, op2_seed_and_align, op3_sampled_splitters, op4_line_hashing, op5_pitman_yor, op6_two_tier_bpe, op7_interval_expansion, op8_transducer_counts, op9_lsh_forest, op10_branch_and_bound, op11_baseline_correction, op12_partition_refinement, op13_compression_bands)}


def oracle_sql() -> dict[str, str]:
    return {"op10_branch_and_bound": OP10_SQL, "op11_baseline_correction": OP11_SQL}


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (
  SELECT r, lang, source, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM d)),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*) AS cnt FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
grp AS (
  SELECT g.lang, g.source, coalesce(n, 0) AS n, coalesce(l.v, 0) AS v
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN (SELECT lang, source, sum(cnt) AS n FROM c GROUP BY lang, source) USING (lang, source)
  LEFT JOIN (SELECT lang, v FROM langs) l ON l.lang = g.lang),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.cnt, 0) AS cnt, k.total,
    1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.cnt, 0) + 2) // CAST(g.n + 2 * g.v AS HUGEINT) AS p
  FROM grp g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (
  SELECT g.lang, g.source, 'pair' AS part, o.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM grp g JOIN grp o ON o.lang = g.lang AND o.source <> g.source
  LEFT JOIN (SELECT a.lang, a.source AS x, b.source AS y, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
             FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3) s
    ON s.lang = g.lang AND s.x = g.source AND s.y = o.source),
term AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value
  FROM (SELECT p.*, 1 + CAST(1000000000 AS HUGEINT) * (p.total + 2) // CAST(l.n + 2 * l.v AS HUGEINT) AS q FROM p JOIN langs l ON l.lang = p.lang)
  WHERE cnt > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
