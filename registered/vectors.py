"""Vectors, recognizers, model batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from dawnchorus.functions import vectors as v
from dawnchorus.operators import framing, publish, recognize, store
from dawnchorus.operators.inference import infer
from dawnchorus.operators.sourcemap import SOURCE_TEMPLATES, SourceMap
from dawnchorus.plans import jobs
from dawnchorus.sizing import scratch_folder
from dawnchorus.sources.tables import decode_definitions, recognizer_definitions

from . import bindings as b
from .bindings import Registry, with_ctes

registry = Registry()


# Little-endian bytes of each element, then base64 of the whole vector.
def packed_sql(column: str) -> str:
    h = "hex(CAST(CAST(CAST(x AS FLOAT) AS BIT) AS BLOB))"
    little = " || ".join(f"substr({h}, {p}, 2)" for p in (7, 5, 3, 1))
    return f"to_base64(unhex(list_aggregate(list_transform({column}, lambda x: {little}), 'string_agg', '')))"


@registry.add(
    with_ctes(
        f"""SELECT source, channel, offset_s AS "offset", {packed_sql('embedding')} AS embeddings,
                   'embeddings.parquet' AS dest
            FROM windows JOIN recordings USING (recording_id)""",
        b.WINDOWS_SQL, b.RECORDINGS_SQL,
    )
)
def embeddings_serialized(spark, sf_dir):
    """Embedding export, vectors packed as text."""
    mapped = jobs.mapped_recordings(b.recordings(spark, sf_dir), None, ())
    rows = jobs.embedding_rows(b.windows(spark, sf_dir), mapped)
    return jobs.format_vectors(rows, "serialized")


@registry.add(
    with_ctes(
        'SELECT source, channel, offset_s AS "offset", \'columns/\' || '
        "regexp_extract(source, '([^/]+)\\.flac$', 1) || '.parquet' AS dest, "
        + ", ".join(f"embedding[{i + 1}] AS f{i:04d}" for i in range(64))
        + " FROM windows JOIN recordings USING (recording_id)",
        b.WINDOWS_SQL, b.RECORDINGS_SQL,
    )
)
def embeddings_columns(spark, sf_dir):
    """Embedding export, one column per element, one destination per recording."""
    recordings = b.recordings(spark, sf_dir)
    windows = store.windows_by_source(b.windows(spark, sf_dir), recordings)
    mapped = jobs.mapped_recordings(recordings, None, ())
    rows = jobs.embedding_rows(windows, mapped, None, "columns", "{embeddings_table_format}/{filestem}{ext}")
    return jobs.format_vectors(rows, "columns")


@registry.add(
    """SELECT vec_id, CAST(len(embedding) AS INTEGER) AS width,
              round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS norm2
       FROM embeddings"""
)
def embeddings_unpacked(spark, sf_dir):
    """Packed and unpacked again: the length and the squared norm must survive."""
    packed = v.pack(b.table(spark, sf_dir, "embeddings"), "embedding", "packed").drop("embedding")
    e = F.col("embedding").cast("array<double>")
    square = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x * x)
    return v.unpack(packed, "packed").select("vec_id", F.size("embedding").alias("width"), F.round(square, 6).alias("norm2"))


@registry.add(f"SELECT vec_id, label, {packed_sql('embedding')} AS embeddings FROM embeddings")
def embeddings_narrowed(spark, sf_dir):
    """Feature columns packed into one column again."""
    wide = v.widen(b.table(spark, sf_dir, "embeddings"), "embedding")
    return v.narrow(wide, ("vec_id", "label"))


@registry.add(
    "SELECT vec_id, " + ", ".join(f"embedding[{i + 1}] AS f{i:04d}" for i in range(64)) + " FROM embeddings"
)
def embeddings_widened_from_text(spark, sf_dir):
    """A packed column to one column per element."""
    packed = v.pack(b.table(spark, sf_dir, "embeddings"), "embedding").select("vec_id", "embeddings")
    return v.unpack_wide(packed)


SCORES_SQL = """scores AS (
  SELECT w.recording_id, w.window_idx, w.channel, w.offset_s, r.classifier_name, r.label,
         list_dot_product(CAST(w.embedding AS DOUBLE[]), CAST(r.beta AS DOUBLE[])) + CAST(r.bias AS DOUBLE) AS score
  FROM windows w, recognizers r)"""


@registry.add(
    with_ctes(
        """SELECT recording_id, window_idx, classifier_name, label, round(score, 6) AS score FROM scores""",
        b.WINDOWS_SQL, b.RECOGNIZERS_SQL, SCORES_SQL,
    )
)
def recognizer_scores(spark, sf_dir):
    """All recognizers over all windows in one pass."""
    scored = recognize.score(
        b.windows(spark, sf_dir), b.recognizers(spark, sf_dir), ["recording_id", "window_idx"]
    )
    return scored.withColumn("score", F.round("score", 6))


@registry.add(
    with_ctes(
        """SELECT recording_id, window_idx, classifier_name, label, round(score, 6) AS score
           FROM scores WHERE score >= 0.5""",
        b.WINDOWS_SQL, b.RECOGNIZERS_SQL, SCORES_SQL,
    )
)
def recognizer_scores_above(spark, sf_dir):
    """Scores at or above a minimum, weights fetched in several blocks."""
    scored = recognize.score(
        b.windows(spark, sf_dir), b.recognizers(spark, sf_dir), ["recording_id", "window_idx"],
        min_score=0.5, block_bytes=2_000,
    )
    return scored.withColumn("score", F.round("score", 6))


@registry.add(
    with_ctes(
        """SELECT 'https://api.acousticsobservatory.org.au/audio_recordings/' || (9000 + recording_id)
                    || '/original' AS source,
                  channel, offset_s AS "offset", label, round(score, 6) AS score,
                  CAST(9000 + recording_id AS VARCHAR) AS audio_recording_id,
                  classifier_name || '/recognizer_results.csv' AS dest
           FROM scores JOIN recordings USING (recording_id)""",
        b.WINDOWS_SQL, b.RECORDINGS_SQL, b.RECOGNIZERS_SQL, SCORES_SQL,
    )
)
def recognizer_export(spark, sf_dir):
    """Recognizer results as they are published, a destination per recognizer."""
    smap = SourceMap(template=SOURCE_TEMPLATES["a2o_original"], pattern="canonical_filename")
    mapped = jobs.mapped_recordings(b.recordings(spark, sf_dir), smap)
    scored = recognize.score(b.windows(spark, sf_dir), b.recognizers(spark, sf_dir), list(jobs.WINDOW_KEY))
    rows = jobs.recognizer_rows(scored, mapped, smap, "{classifier_name}/{analysis}{ext}", "csv")
    return rows.withColumn("score", F.round("score", 6))


@registry.add(
    with_ctes(
        """SELECT classifier_name, CAST(class_idx AS INTEGER) AS class_idx, label, bias,
                  CAST(len(beta) AS INTEGER) AS embedding_dim,
                  round(list_sum(CAST(beta AS DOUBLE[])), 6) AS weight_sum
           FROM recognizers""",
        b.RECOGNIZERS_SQL,
    )
)
def recognizer_decoded(spark, sf_dir):
    """Packed definitions back to weights."""
    return _weights(decode_definitions(_definitions(spark, sf_dir)))


def _definitions(spark, sf_dir):
    r = b.recognizers(spark, sf_dir)
    packed = v.pack(v.pack(r.withColumn("one", F.array("bias")), "beta", "beta_text"), "one", "bias_text")
    config = F.struct(
        F.lit("model").alias("model_key"), "embedding_dim",
        F.struct(F.lit(5.0).alias("window_size_s"), F.lit(5.0).alias("hop_size_s")).alias("model_config"),
    )
    return packed.select(
        F.col("classifier_name").alias("name"),
        F.array("label").alias("classes"),
        F.col("beta_text").alias("beta"),
        F.col("bias_text").alias("beta_bias"),
        config.alias("model_config"),
    )


def _weights(decoded):
    total = F.aggregate(F.col("beta").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return decoded.select(
        "classifier_name", "class_idx", "label", "bias", "embedding_dim", F.round(total, 6).alias("weight_sum")
    )


@registry.add(
    with_ctes(
        """SELECT classifier_name, CAST(class_idx AS INTEGER) AS class_idx, label, bias,
                  CAST(len(beta) AS INTEGER) AS embedding_dim,
                  round(list_sum(CAST(beta AS DOUBLE[])), 6) AS weight_sum
           FROM recognizers""",
        b.RECOGNIZERS_SQL,
    )
)
def recognizer_definitions_read(spark, sf_dir):
    """The same written as JSON files, one each, and read by the reader of definitions."""
    folder = scratch_folder(spark)
    _definitions(spark, sf_dir).write.option("maxRecordsPerFile", 1).json(folder)
    return _weights(recognizer_definitions(spark, folder))


@registry.add(
    with_ctes(
        """SELECT source, channel, offset_s AS "offset", regexp_replace(source, '\\.flac$', '.parquet') AS dest,
                  CAST(len(embedding) AS INTEGER) AS width, embedding[1] AS first_value, embedding[-1] AS last_value
           FROM windows JOIN recordings USING (recording_id)""",
        b.WINDOWS_SQL, b.RECORDINGS_SQL,
    )
)
def embeddings_published(spark, sf_dir):
    """The embedding export, written, read back and unpacked."""
    root = scratch_folder(spark)
    output = jobs.Output(root, "parquet", layout="nested_filestem")
    jobs.export_embeddings(b.windows(spark, sf_dir).drop("label"), b.recordings(spark, sf_dir), output)
    back = v.unpack(publish.read_published(spark, root), "embeddings", "vector")
    return back.select(
        "source", "channel", "offset", "dest", F.size("vector").alias("width"),
        F.element_at("vector", 1).alias("first_value"), F.element_at("vector", -1).alias("last_value"),
    )



@registry.add(
    with_ctes(
        """SELECT classifier_name, 32 AS dimension, 64 AS width FROM recognizers
           WHERE classifier_name >= 'rec_5'""",
        b.RECOGNIZERS_SQL,
    )
)
def recognizer_misfits(spark, sf_dir):
    """Recognizers whose dimension isn't that of the vectors."""
    half = F.when(F.col("classifier_name") >= "rec_5", F.slice("beta", 1, 32)).otherwise(F.col("beta"))
    recs = b.recognizers(spark, sf_dir).withColumn("beta", half)
    return recognize.misfits(b.windows(spark, sf_dir), recs)


# A vector of 64 as two channels of 32.
@registry.add(
    """SELECT vec_id, CAST(c AS INTEGER) AS channel,
              round(list_sum(CAST(embedding[c * 32 + 1 : c * 32 + 32] AS DOUBLE[])), 6) AS vector_sum,
              embedding[c * 32 + 5] AS fifth_logit
       FROM embeddings, (SELECT unnest([0, 1]) AS c)"""
)
def channels_expanded(spark, sf_dir):
    """One row per channel, logits aligned by position."""
    halves = F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))
    nested = b.table(spark, sf_dir, "embeddings").select("vec_id", halves.alias("embeddings"), halves.alias("scores"))
    rows = framing.expand_channels(nested, "embeddings", "scores")
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        "vec_id", "channel", F.round(total, 6).alias("vector_sum"), F.get("logits", F.lit(4)).alias("fifth_logit")
    )


@registry.add(
    """SELECT vec_id, CAST(c AS INTEGER) AS channel, embedding[c * 32 + 1] AS first_value, embedding[7] AS seventh_logit
       FROM embeddings, (SELECT unnest([0, 1]) AS c)"""
)
def channels_share_logits(spark, sf_dir):
    """Logits given once per window repeat on every channel."""
    halves = F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))
    nested = b.table(spark, sf_dir, "embeddings").select("vec_id", halves.alias("embeddings"), F.col("embedding").alias("logits"))
    rows = framing.expand_channels(nested, "embeddings", "logits")
    return rows.select(
        "vec_id", "channel", F.get("embedding", F.lit(0)).alias("first_value"), F.get("logits", F.lit(6)).alias("seventh_logit")
    )


# A stand-in model: four frames of 16 samples, one channel, three fixed projections as logits.
WEIGHTS_SQL = "list_transform(generate_series(0, 15), lambda i: CAST((i * 7 + k * 3) % 11 - 5 AS DOUBLE) / 10)"


def projection_model():
    def load():
        import numpy as np

        weights = np.array([[((i * 7 + k * 3) % 11 - 5) / 10 for k in range(3)] for i in range(16)])

        def model(samples):
            frames = samples.reshape(-1, 1, 16)
            return frames, {"label": (frames[:, 0].astype("float64") @ weights).astype("float32")}

        return model

    return load


MODEL_SQL = f"""SELECT vec_id, CAST(t AS INTEGER) AS t, 0 AS channel, embedding[t * 16 + 1] AS first_value,
               round(max(CASE WHEN k = 0 THEN p END), 4) AS logit0,
               round(max(CASE WHEN k = 1 THEN p END), 4) AS logit1,
               round(max(CASE WHEN k = 2 THEN p END), 4) AS logit2
        FROM (SELECT vec_id, embedding, t, k,
                     CAST(CAST(list_dot_product(CAST(embedding[t * 16 + 1 : t * 16 + 16] AS DOUBLE[]), {WEIGHTS_SQL}) AS FLOAT) AS DOUBLE) AS p
              FROM embeddings, (SELECT unnest(generate_series(0, 3)) AS t), (SELECT unnest(generate_series(0, 2)) AS k))
        GROUP BY vec_id, embedding, t"""


@registry.add(MODEL_SQL)
def model_batches(spark, sf_dir):
    """A caller's model applied in batches: embeddings and logits per window and channel."""
    rows = infer(b.table(spark, sf_dir, "embeddings"), projection_model(), "embedding", ["vec_id"], with_logits=True)
    logit = [F.round(F.get("logits", F.lit(k)).cast("double"), 4).alias(f"logit{k}") for k in range(3)]
    return rows.select("vec_id", "t", "channel", F.get("embedding", F.lit(0)).alias("first_value"), *logit)


def block_model():
    """The same for a block of shards at once."""

    def load():
        one = projection_model()()

        def model(samples):
            frames, logits = one(samples)  # the frames of all shards, one after the other
            per_shard = samples.shape[1] // 16
            return frames.reshape(len(samples), per_shard, 1, 16), {"label": logits["label"].reshape(len(samples), per_shard, 3)}

        return model

    return load


@registry.add(MODEL_SQL)
def model_blocks(spark, sf_dir):
    """The model called once per 32 shards of a task; results split back to the shards."""
    shards = b.table(spark, sf_dir, "embeddings")
    rows = infer(shards, block_model(), "embedding", ["vec_id"], with_logits=True, batch_size=32, frames=lambda n: n // 16)
    logit = [F.round(F.get("logits", F.lit(k)).cast("double"), 4).alias(f"logit{k}") for k in range(3)]
    return rows.select("vec_id", "t", "channel", F.get("embedding", F.lit(0)).alias("first_value"), *logit)
