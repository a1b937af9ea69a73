"""Recordings to shards, shards to windows, windows to channels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnchorus.schemas import require_columns

SHARD_S = 60.0
MIN_AUDIO_S = 1.0
WINDOW_S = 5.0
HOP_S = 5.0
SHARDS_PER_TASK = 512  # some eight and a half hours of audio
BLOCK = 4096  # shards generated from one row, so that no array grows with a recording


def shard_recordings(
    recordings: DataFrame, shard_s: float = SHARD_S, min_audio_s: float = MIN_AUDIO_S
) -> DataFrame:
    """Cut each recording (``duration_s``) into shards; drop shards below the minimum.

    Two nested generators: blocks of shards, then the shards of a block. A
    very long recording thus never becomes one huge array in one row.
    """
    require_columns(recordings, ["duration_s"], "recordings")
    n_shards = F.ceil(F.col("duration_s") / shard_s)
    last_block = F.floor((F.col("__n") - 1) / F.lit(BLOCK))
    first = F.col("__block") * BLOCK
    shards = (
        recordings.withColumn("__n", n_shards)
        .where(F.col("__n") > 0)
        .withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), last_block)))
        .withColumn(
            "__i", F.explode(F.sequence(first, F.least(first + BLOCK, F.col("__n")) - 1))
        )
        .withColumn("shard_idx", F.col("__i").cast("int"))
        .withColumn("shard_offset_s", F.col("__i") * F.lit(float(shard_s)))
        .withColumn(
            "shard_len_s",
            F.least(F.lit(float(shard_s)), F.col("duration_s") - F.col("shard_offset_s")),
        )
    )
    return shards.where(F.col("shard_len_s") >= min_audio_s).drop("__n", "__block", "__i")


def spread_shards(shards: DataFrame, partitions: int | None = None) -> DataFrame:
    """Even out shards over tasks before the costly step that follows.

    Shard rows are small, so this shuffle is cheap. Ranges of deployment,
    recording and shard split a recording that holds much of the audio, and
    leave each task with few deployments, hence few files in the store. The
    number of tasks follows the number of shards, ``SHARDS_PER_TASK`` each, and is no less
    than the session's: by their bytes the rows would be merged into a
    handful of tasks, although the work behind each is large.
    """
    if partitions is None:
        least = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        partitions = max(least, math.ceil(shards.count() / SHARDS_PER_TASK))
    keys = [c for c in ("deployment", "recording_id", "shard_idx") if c in shards.columns]
    return shards.repartitionByRange(partitions, *keys)


def window_count(length_s: Column, window_s: float, hop_s: float, partial: str) -> Column:
    """Number of windows in a shard, at least one.

    ``drop``: only windows that fit. ``pad``: a shorter rest still gets one.
    """
    rest = (length_s - F.lit(float(window_s))) / hop_s
    if partial == "drop":
        n = F.floor(rest) + 1
    elif partial == "pad":
        n = F.least(F.ceil(rest) + 1, F.ceil(length_s / hop_s))
    else:
        raise ValueError("partial must be 'drop' or 'pad'")
    return F.greatest(F.lit(1).cast("long"), n)


def window_shards(
    shards: DataFrame,
    window_s: float = WINDOW_S,
    hop_s: float = HOP_S,
    shard_s: float = SHARD_S,
    partial: str = "drop",
) -> DataFrame:
    """Windows of each shard; a window never crosses into the next shard."""
    require_columns(shards, ["shard_idx", "shard_offset_s", "shard_len_s"], "shards")
    last = window_count(F.col("shard_len_s"), window_s, hop_s, partial) - 1
    per_shard = max(1, -int(-shard_s // hop_s))
    return (
        shards.withColumn("__t", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .withColumn("window_idx", (F.col("shard_idx") * per_shard + F.col("__t")).cast("int"))
        .withColumn("offset_s", F.col("shard_offset_s") + F.col("__t") * F.lit(float(hop_s)))
        .withColumn("end_s", F.col("offset_s") + F.lit(float(window_s)))
        .drop("__t")
    )


def expand_channels(
    windows: DataFrame, vectors: str = "embeddings", logits: str | None = None
) -> DataFrame:
    """One row per channel from ``array<array<float>>`` vectors.

    Logits given per channel are taken by position; logits given once per
    window (a flat array) repeat on every channel.
    """
    keep = [c for c in windows.columns if c not in (vectors, logits)]
    rows = windows.select(
        *keep, *([logits] if logits else []), F.posexplode(vectors).alias("channel", "embedding")
    )
    if logits is None:
        return rows
    per_channel = windows.schema[logits].dataType.elementType.typeName() == "array"
    aligned = F.get(F.col(logits), F.col("channel")) if per_channel else F.col(logits)
    return rows.withColumn("logits", aligned).drop(*({logits} - {"logits"}))
