"""The registered queries of the operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dawnchorus.llm import (
    alignment, decontaminate, language, manifest, mixing, near_dup, pitman_yor, quality_model, quality_rules, secrets, sql, substring_dup, token_counts, toxicity,
)
from dawnchorus.llm.common import scratch_root


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source is the owner, language within source stands for the repository."""
    repository = F.concat_ws("/", "source", "lang")
    found = secrets.secrets(_table(spark, sf_dir, "documents"), owner=F.col("source"), repository=repository)
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_list", 256).alias("base_sha256"),
        F.col("span_list").alias("spans"), "n_live", "n_copied",
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dup.substring_duplicates(_table(spark, sf_dir, "documents"), window=35)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)
    same = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return found.select("doc_id", "n_shingles", "component_id", same.alias("kept"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache starts empty: every distinct text is a miss, is encoded once and appended."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    cache = os.path.join(scratch_root(spark), f"token-cache-{uuid.uuid4().hex}")
    return token_counts.token_counts(
        _table(spark, sf_dir, "documents"), cache, tokenizer=token_counts.file_digest(path), load=token_counts.piece_encoder(path)
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances are given in ten thousandths, -1 where there are none."""
    found = quality_rules.quality(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        *[F.coalesce(F.round(F.col(c) * 10_000), F.lit(-1)).cast("long").alias(c) for c in ("char_distance", "word_distance")],
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(_table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def _micros(positions: Column) -> Column:
    return F.floor(F.coalesce(F.get(positions, F.lit(0)), F.lit(-1.0)) * 1_000_000 + 0.5).cast("long")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixture(_table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", "taken", F.size("positions").cast("long").alias("n_copies"),
        _micros(F.col("positions")).alias("first_position_ppm"),
    )


# Times of the schedules of mixing.SCHEDULES, solved for a share s of the whole demand.
OP10_SQL = """
WITH docs AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) AS BIGINT) AS size,
         md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS turn
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM sizes),
weighed AS (SELECT *, [3, 1, 2][(rank - 1) % 3 + 1] AS weight FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER () * 150
             - 100 * coalesce(sum(2 * source_size) OVER (ORDER BY source_size / weight, rank
                                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (100 * sum(weight) OVER (ORDER BY source_size / weight, rank
                                       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level
  FROM weighed),
targets AS (
  SELECT source, source_size, rank,
         least(CAST(2 * source_size AS DOUBLE), weight * max(CAST(level AS DOUBLE)) OVER ()) AS target
  FROM levels),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.rank, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.turn, d.doc_id
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS rounds
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
parted AS (
  SELECT *, greatest(least(CAST(floor(target - rounds * source_size + 0.5) AS BIGINT) - before, size), 0) AS part
  FROM placed),
shared AS (
  SELECT *, rounds * size + part AS taken,
         CASE WHEN size = 0 THEN 0 ELSE rounds END + CASE WHEN part > 0 THEN 1 ELSE 0 END AS n_copies,
         (before + CASE WHEN rounds > 0 THEN size ELSE part END / 2) / target AS s
  FROM parted),
timed AS (
  SELECT *, CASE (rank - 1) % 4
    WHEN 0 THEN CASE WHEN s >= 1 THEN 1 ELSE 2 * s / (0.5 + sqrt(0.25 + 2 * s)) END
    WHEN 1 THEN CASE WHEN s >= 1 THEN 1 ELSE 2 * s / (1 + sqrt(1.0)) END
    WHEN 2 THEN CASE WHEN s >= 1 THEN 1 ELSE 2 * s / (1.5 + sqrt(greatest(2.25 - 2 * s, 0))) END
    ELSE CASE WHEN s < 0.5 THEN 2 * s / (0.5 + sqrt(0.25 + 4 * s))
              WHEN s < 1 THEN 0.5 + 2 * (s - 0.5) / (1.5 + sqrt(greatest(2.25 - 4 * (s - 0.5), 0))) ELSE 1 END
    END AS position
  FROM shared)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken, CAST(n_copies AS BIGINT) AS n_copies,
       CAST(CASE WHEN n_copies = 0 THEN floor(-1000000 + 0.5) ELSE floor(position * 1000000 + 0.5) END AS BIGINT)
         AS first_position_ppm
FROM timed"""


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = [public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.alignment_report(_table(spark, sf_dir, "documents"), *paths)


def op12_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.scores(_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verified(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_substring_dedup, op3_near_dedup, op4_token_counts, op5_decontaminate, op6_quality_rules,
        op7_toxicity, op8_language_id, op9_quality_classifier, op10_mixing, op11_token_alignment,
        op12_pitman_yor, op13_merkle_manifest, pipeline,
    )
}

SQL = {
    "op1_secret_scan": sql.OP1, "op2_substring_dedup": sql.OP2, "op3_near_dedup": sql.OP3, "op5_decontaminate": sql.OP5,
    "op6_quality_rules": sql.OP6, "op10_mixing": OP10_SQL, "op13_merkle_manifest": sql.OP13,
}
