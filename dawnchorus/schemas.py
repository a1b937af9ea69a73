"""Table layouts shared by the operators, as DDL strings.

Only the columns an operator names are needed; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

MANIFEST = "path string, source string, depth int, length long, duration_s double"
RECORDINGS = "recording_id long, source string, deployment string, dataset string, duration_s double"
SHARDS = "recording_id long, source string, shard_idx int, shard_offset_s double, shard_len_s double"
WINDOWS = (
    "recording_id long, window_idx int, channel int, offset_s double, end_s double, "
    "embedding array<float>"
)
WINDOWS_WITH_LOGITS = WINDOWS + ", logits array<float>"
LOGITS_LONG = "recording_id long, window_idx int, channel int, offset_s double, class_idx int, logit double"
CLASSES = "class_idx int, label string"
DETECTIONS = "recording_id long, offset_s double, channel int, label string, score double"
STAGED_DETECTIONS = "window_id string, recording_id long, offset_s double, species string, score double"
EMBEDDINGS_SERIALIZED = "source string, channel int, offset double, embeddings string"
RESULTS = "source string, channel int, offset double, label string, score double"
RECOGNIZERS = (
    "classifier_name string, class_idx int, label string, beta array<float>, bias float, embedding_dim int"
)
LABEL_LIST = "item_ord long, raw string"
TAXONOMY_LABELS = "namespace string, ord long, label string"
TAXONOMY_MAP = "mapping string, target_namespace string, ord long, src string, dst string"
RUN_SUMMARY = "windows long, audio_s double, elapsed_s double, elapsed_s_per_audio_hour double"

RESULT_COLUMNS = ("source", "channel", "offset", "label", "score")
STAGED_REQUIRED = ("recording_id", "offset_s", "species", "score")


def require_columns(df: DataFrame, required, what: str) -> DataFrame:
    """Return ``df``, or raise if a required column is absent."""
    absent = sorted(set(required) - set(df.columns))
    if absent:
        raise ValueError(f"{what} lacks required columns: {absent}")
    return df
