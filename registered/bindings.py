"""How the test tables stand in for recordings, windows, logits and lists.

Every binding exists twice: as a DataFrame and as a SQL common table
expression with the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


class Registry:
    def __init__(self):
        self.queries: list[Query] = []

    def add(self, sql: str | None):
        def register(fn):
            self.queries.append(Query(fn.__name__, fn, sql))
            return fn

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_ctes(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


# Windows: a vector per window, 20 windows per recording.
WINDOWS_SQL = """windows AS (
  SELECT vec_id // 20 AS recording_id, CAST(vec_id % 20 AS INTEGER) AS window_idx,
         0 AS channel, CAST(vec_id % 20 AS DOUBLE) * 5.0 AS offset_s, embedding, label
  FROM embeddings)"""


def windows(spark, sf_dir) -> DataFrame:
    idx = F.pmod("vec_id", F.lit(20)).cast("int")
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 20).alias("recording_id"),
        idx.alias("window_idx"),
        F.lit(0).alias("channel"),
        (idx * F.lit(5.0)).alias("offset_s"),
        "embedding",
        "label",
    )


RECORDINGS_SQL = """recordings AS (
  SELECT DISTINCT vec_id // 20 AS recording_id,
         'site' || ((vec_id // 20) % 3) || '/20210428T100000Z_Dry-' || (vec_id // 20)
           || '_' || (9000 + vec_id // 20) || '.flac' AS source
  FROM embeddings)"""


def recordings(spark, sf_dir) -> DataFrame:
    rid = F.col("recording_id")
    ids = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("recording_id"))
    source = F.concat(
        F.lit("site"), (rid % 3).cast("string"), F.lit("/20210428T100000Z_Dry-"), rid.cast("string"),
        F.lit("_"), (rid + 9000).cast("string"), F.lit(".flac"),
    )
    return ids.distinct().select("recording_id", source.alias("source"))


# Classes: one per logit position.
CLASSES_SQL = """classes AS (
  SELECT CAST(i AS INTEGER) AS class_idx, 'class_' || i AS label
  FROM (SELECT unnest(generate_series(0, (SELECT max(len(embedding)) FROM embeddings) - 1)) AS i))"""


def classes(spark, sf_dir) -> DataFrame:
    width = table(spark, sf_dir, "embeddings").agg(F.max(F.size("embedding")).alias("n"))
    idx = width.select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("class_idx"))
    return idx.select("class_idx", F.concat(F.lit("class_"), F.col("class_idx").cast("string")).alias("label"))


# A species list written in another case: one entry per nation.
SPECIES_SQL = """species AS (
  SELECT CAST(n_nationkey AS BIGINT) AS item_ord, ' CLASS_' || n_nationkey AS raw FROM nation)"""


def species(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("item_ord"),
        F.concat(F.lit(" CLASS_"), F.col("n_nationkey").cast("string")).alias("raw"),
    )


# Logits in long form: a window per order, a class per supplier.
LONG_LOGITS_SQL = """long_logits AS (
  SELECT l_orderkey AS window_id, CAST(l_suppkey AS INTEGER) AS class_idx, l_quantity AS logit,
         l_partkey, l_linenumber FROM lineitem)"""


def long_logits(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("window_id"),
        F.col("l_suppkey").cast("int").alias("class_idx"),
        F.col("l_quantity").alias("logit"),
        "l_partkey",
        "l_linenumber",
    )


LONG_CLASSES_SQL = """long_classes AS (
  SELECT CAST(s_suppkey AS INTEGER) AS class_idx, s_name AS label, s_acctbal FROM supplier)"""


def long_classes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("int").alias("class_idx"), F.col("s_name").alias("label"), "s_acctbal"
    )


# Audio files: one per order, canonical names, some of them at the root.
AUDIO_FILES_SQL = """audio_files AS (
  SELECT o_orderkey AS recording_id,
         CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'site_' || o_orderstatus || '/' END
           || strftime(o_orderdate, '%Y%m%dT%H%M%S') || 'Z_' || o_orderpriority || '_' || o_orderkey
           || '.flac' AS source,
         CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice / 100 END AS duration_s
  FROM orders)"""


def audio_files(spark, sf_dir) -> DataFrame:
    folder = F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(
        F.concat(F.lit("site_"), F.col("o_orderstatus"), F.lit("/"))
    )
    name = F.concat(
        folder,
        F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss"),
        F.lit("Z_"),
        F.col("o_orderpriority"),
        F.lit("_"),
        F.col("o_orderkey").cast("string"),
        F.lit(".flac"),
    )
    unreadable = F.col("o_orderpriority") == "5-LOW"
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("recording_id"),
        name.alias("source"),
        F.when(~unreadable, F.col("o_totalprice") / 100).alias("duration_s"),
    )


# Paths of several depths and odd file names: addresses of pages without their scheme.
PAGE_PATHS_SQL = """page_paths AS (
  SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS source FROM pages)"""


def page_paths(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("source")
    )


# Last path component as a path library sees it: a trailing slash doesn't count.
PAGE_NAMES_SQL = """page_names AS (
  SELECT page_id, source, string_split(rtrim(source, '/'), '/')[-1] AS name FROM page_paths)"""


# Recordings to be framed: the duration of each order line.
LINE_RECORDINGS_SQL = """line_recordings AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity * 2.0 AS duration_s FROM lineitem)"""


def line_recordings(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", (F.col("l_quantity") * 2.0).alias("duration_s")
    )


# Recognizers: per label the vector with the lowest id.
RECOGNIZERS_SQL = """recognizers AS (
  SELECT 'rec_' || label AS classifier_name, 0 AS class_idx, 'call_' || label AS label,
         embedding AS beta, CAST(label * 0.01 AS FLOAT) AS bias
  FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1)"""


def recognizers(spark, sf_dir) -> DataFrame:
    first = (
        table(spark, sf_dir, "embeddings")
        .groupBy("label")
        .agg(F.min_by("embedding", "vec_id").alias("beta"))
    )
    tag = F.col("label").cast("string")
    return first.select(
        F.concat(F.lit("rec_"), tag).alias("classifier_name"),
        F.lit(0).alias("class_idx"),
        F.concat(F.lit("call_"), tag).alias("label"),
        "beta",
        (F.col("label") * F.lit(0.01)).cast("float").alias("bias"),
        F.size("beta").alias("embedding_dim"),
    )


def score6(name: str = "score"):
    return F.round(F.col(name), 6).alias(name)
