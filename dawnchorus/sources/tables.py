"""Staged tables, recognizer definitions and label lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dawnchorus.functions.vectors import unpack
from dawnchorus.schemas import STAGED_REQUIRED, require_columns


def staged_detections(spark: SparkSession, path: str) -> DataFrame:
    """Staged detections; a table lacking a required column is an error.

    A recording id staged as text becomes a number again.
    """
    df = require_columns(spark.read.parquet(path), STAGED_REQUIRED, "staged detections")
    return df.withColumn("recording_id", F.col("recording_id").cast("long"))


DEFINITION = (
    "name string, classes array<string>, beta string, beta_bias string, "
    "model_config struct<model_key: string, embedding_dim: int, "
    "model_config: struct<window_size_s: double, hop_size_s: double, sample_rate: int>>"
)


def recognizer_definitions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Recognizers of one or several JSON files, one row per class.

    A file holds one definition, a list of them, or a list under the key
    ``recognizers``. Weights are packed float32; with several classes they lie
    dimension by dimension, the classes of a dimension next to each other.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    one = T.StructType.fromDDL(DEFINITION)
    schema = T.StructType([*one.fields, T.StructField("recognizers", T.ArrayType(one))])
    files = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(paths)
    itself = F.array(F.struct(*one.fieldNames()))
    return decode_definitions(files.select(F.inline(F.coalesce("recognizers", itself))))


def decode_definitions(definitions: DataFrame) -> DataFrame:
    """Packed definitions to (classifier_name, class_idx, label, beta, bias, embedding_dim).

    A definition without classes, or whose weights or biases don't number
    classes x dimension and classes, fails the read.
    """
    decoded = unpack(unpack(definitions, "beta", "__weights"), "beta_bias", "__bias")
    n = F.size("classes")
    dim = F.col("model_config.embedding_dim")
    weights = F.size("__weights")
    fits = (n > 0) & (F.size("__bias") == n) & (weights > 0) & (weights == n * F.coalesce(dim, F.floor(weights / n)))
    misfit = F.concat(
        F.lit("recognizer "), F.coalesce("name", F.lit("without a name")),
        F.lit(": classes, weights, biases and embedding_dim don't fit together"),
    )
    classes = F.when(F.coalesce(fits, F.lit(False)), F.col("classes")).otherwise(
        F.raise_error(misfit).cast("array<string>")
    )
    rows = decoded.select(
        F.col("name").alias("classifier_name"),
        dim.alias("embedding_dim"),
        n.alias("__n"),
        "__weights",
        "__bias",
        F.posexplode(classes).alias("class_idx", "label"),
    )
    beta = F.transform(
        F.sequence(F.lit(0), F.coalesce(F.col("embedding_dim"), (F.size("__weights") / F.col("__n")).cast("int")) - 1),
        lambda i: F.get(F.col("__weights"), i * F.col("__n") + F.col("class_idx")),
    )
    return rows.select(
        "classifier_name",
        "class_idx",
        "label",
        beta.alias("beta"),
        F.get(F.col("__bias"), F.col("class_idx")).alias("bias"),
        "embedding_dim",
    )


def label_file(spark: SparkSession, path: str) -> DataFrame:
    """A text file of labels in file order: (item_ord, raw).

    The order is the byte position of the file split plus the line's number in
    it, which grows along the file however it is split.
    """
    in_split = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return spark.read.text(path).select(
        (F.col("_metadata.file_block_start") + in_split).alias("item_ord"), F.col("value").alias("raw")
    )
