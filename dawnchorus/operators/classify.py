"""Class scores to detections: calibration, threshold, allowed classes, top-N."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dawnchorus.checks import require_none
from dawnchorus.functions.text import casefold, strip
from dawnchorus.schemas import STAGED_REQUIRED, require_columns
from dawnchorus.sizing import broadcast_if_small

# Calibration moving the decision boundary of the logits near 0.
LOGIT_SCALE = 0.97
LOGIT_SHIFT = -10.0
DEFAULT_THRESHOLD = 0.0
DEFAULT_TOP_N = 10

# Above this N the optimizer no longer limits groups before the shuffle.
GROUP_LIMIT_BOUND = 1000
SALTS = 64


def calibrate(logit: Column) -> Column:
    return logit.cast("double") * F.lit(LOGIT_SCALE) + F.lit(LOGIT_SHIFT)


def passes(score: Column, threshold: float) -> Column:
    """At or above the threshold. NaN, which Spark orders highest, never passes."""
    return ~F.isnan(score) & (score >= F.lit(float(threshold)))


def explode_logits(windows: DataFrame, column: str = "logits") -> DataFrame:
    """(window, class_idx, logit) rows from the logit array."""
    keep = [c for c in windows.columns if c != column]
    return windows.select(*keep, F.posexplode(column).alias("class_idx", "logit"))


def top_classes(
    windows: DataFrame,
    column: str = "logits",
    threshold: float = DEFAULT_THRESHOLD,
    top_n: int | None = DEFAULT_TOP_N,
    allowed: list[int] | DataFrame | None = None,
    width: int | None = None,
) -> DataFrame:
    """Best classes of each window, for logits held as one array per row.

    Windows whose best class misses the threshold are dropped by one pass over
    the array. All classes of a window are in one row, so the others are cut,
    ranked and shortened where they are, in Arrow batches: nothing is shuffled.
    Only the classes that pass are sorted.

    Each row is its own window. Ties go to the higher class index. With
    ``width`` a logit vector of another length fails the job, at no extra pass
    over the logits. ``allowed`` are class positions, or a table of them: a
    list that comes with the job, no longer than one logit vector.
    """
    keep = [c for c in windows.columns if c != column]
    logits = F.col(column)
    hopeful = passes_max(column, threshold)
    if width is not None:
        message = f"logit width doesn't match the {width} class names"
        matching = F.when(F.size(logits) == width, hopeful)
        hopeful = matching.when(logits.isNotNull(), F.raise_error(F.lit(message)).cast("boolean"))
    rows = windows.where(hopeful).select(*keep, column)
    if top_n is None:
        scored = explode_logits(rows, column).withColumn("score", calibrate(F.col("logit"))).drop("logit")
        scored = scored.where(passes(F.col("score"), threshold))
        if isinstance(allowed, DataFrame):
            return allowed_only(scored, allowed)
        return scored if allowed is None else scored.where(F.col("class_idx").isin(*allowed) if allowed else F.lit(False))
    if isinstance(allowed, DataFrame):
        allowed = [r[0] for r in allowed.select("class_idx").where("class_idx >= 0").distinct().collect()]
    fields = T.StructType([*rows.drop(column).schema, T.StructField("class_idx", T.IntegerType()),
                           T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_best(keep, column, float(threshold), top_n, allowed), fields)


def _best(keep: list[str], column: str, threshold: float, top_n: int, allowed: list[int] | None):
    positions = None if allowed is None else np.unique(np.asarray(allowed, dtype=np.int64))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            vectors = batch.column(column)
            ends = np.cumsum(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype("float64")
            scores = flat * LOGIT_SCALE + LOGIT_SHIFT
            hits = np.flatnonzero(scores >= threshold)  # false for NaN and null
            row = np.searchsorted(ends, hits, side="right")
            cls = hits - (ends - np.diff(ends, prepend=0))[row]
            if positions is not None:
                wanted = np.isin(cls, positions)
                hits, row, cls = hits[wanted], row[wanted], cls[wanted]
            order = np.lexsort((-cls, -scores[hits], row))
            hits, row, cls = hits[order], row[order], cls[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row, side="left")
            best = rank < top_n
            take = pa.array(row[best])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k).take(take) for k in keep], pa.array(cls[best], pa.int32()), pa.array(scores[hits[best]])],
                names=[*keep, "class_idx", "score"],
            )

    return run


def passes_max(column: str, threshold: float) -> Column:
    """Whether any class may pass; calibration keeps the order of logits."""
    best = F.array_max(column)
    return F.isnan(best) | (calibrate(best) >= F.lit(float(threshold)))


def top_classes_long(
    logits: DataFrame,
    window_keys: list[str],
    threshold: float = DEFAULT_THRESHOLD,
    top_n: int | None = DEFAULT_TOP_N,
    allowed: DataFrame | None = None,
    tie_keys: tuple[str, ...] = (),
    class_key: str = "class_idx",
    logit: str = "logit",
) -> DataFrame:
    """Best classes of each window, for logits in long form.

    ``row_number() <= N`` lets Spark keep N rows per window *before* the
    shuffle, so a window key holding a large part of all rows sends only N
    rows per task. Where N is too large for that rule, the group is first
    limited per salt; without N nothing is shuffled at all.
    """
    scored = logits.withColumn("score", calibrate(F.col(logit)))
    scored = scored.where(passes(F.col("score"), threshold)).drop(logit)
    if allowed is not None:
        scored = allowed_only(scored, allowed, class_key)
    if top_n is None:
        return scored
    order = [F.desc("score"), F.desc(class_key), *[F.desc(k) for k in tie_keys]]
    if top_n > GROUP_LIMIT_BOUND:
        salt = F.pmod(F.xxhash64(class_key, *tie_keys), F.lit(SALTS))
        scored = _ranked(scored.withColumn("__salt", salt), [*window_keys, "__salt"], order, top_n)
        scored = scored.drop("__salt")
    return _ranked(scored, window_keys, order, top_n)


def _ranked(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def allowed_only(rows: DataFrame, allowed: DataFrame, class_key: str = "class_idx") -> DataFrame:
    """Rows of allowed classes; an empty list leaves no rows."""
    keys = allowed.select(class_key).distinct()
    return rows.join(broadcast_if_small(keys), class_key, "left_semi")


def allowed_classes(classes: DataFrame, species: DataFrame, name: str = "raw") -> DataFrame:
    """Classes whose label equals a listed name, ignoring case and outer blanks.

    Only the label lists are folded, never the detections.
    """
    wanted = species.select(casefold(strip(F.col(name))).alias("__fold")).where("__fold <> ''").distinct()
    folded = classes.withColumn("__fold", casefold(F.col("label")))
    return folded.join(wanted, "__fold", "left_semi").drop("__fold")


def name_classes(detections: DataFrame, classes: DataFrame, class_key: str = "class_idx") -> DataFrame:
    """Add ``label`` by class position."""
    names = broadcast_if_small(classes.select(class_key, "label"))
    return detections.join(names, class_key).drop(class_key)


def require_matching_width(windows: DataFrame, classes: DataFrame, column: str = "logits") -> None:
    """Every logit vector must be as long as the class list.

    Reads all logits; inside a job rather pass ``width`` to :func:`top_classes`.
    """
    n = classes.count()
    size = F.size(column)
    low, high = windows.where(F.col(column).isNotNull()).agg(F.min(size), F.max(size)).first()
    if low is not None and (low != n or high != n):
        raise ValueError(
            f"logit width doesn't match the class names: logits {low} to {high}, names {n}"
        )


def reverse_mapping(mapping: DataFrame) -> DataFrame:
    """(src, dst) pairs as dst -> src; of several sources the last one stays."""
    return mapping.groupBy(F.col("dst").alias("src")).agg(F.max_by("src", "ord").alias("dst"))


def latest_mapping(mapping: DataFrame) -> DataFrame:
    """One target per source; the last pair stays."""
    return mapping.groupBy("src").agg(F.max_by("dst", "ord").alias("dst"))


def pick_class_list(lists: dict[str, DataFrame], order: tuple[str, ...] = ("label", "labels")) -> DataFrame | None:
    """The class list of a model that offers several: by preference, else ``classes``."""
    for key in (*order, "classes"):
        if key in lists:
            return lists[key]
    return None


def resolve_class_names(
    classes: DataFrame,
    code_to_name: DataFrame | None = None,
    label_to_code: DataFrame | None = None,
) -> DataFrame:
    """Species names for class codes.

    A label becomes its species code where mapped; the name is looked up by
    that code, then by the label. An empty name counts as missing, an absent
    one leaves the code. Without any mapping the labels stay as they are.
    """
    if code_to_name is None and label_to_code is None:
        return classes
    out = classes
    if label_to_code is None:
        out = out.withColumn("__code", F.col("label"))
    else:
        codes = latest_mapping(label_to_code).select(
            F.col("src").alias("label"), F.col("dst").alias("__mapped")
        )
        out = out.join(codes, "label", "left")
        out = out.withColumn("__code", F.coalesce("__mapped", "label")).drop("__mapped")
    if code_to_name is None:
        return out.withColumn("label", F.col("__code")).drop("__code")
    names = latest_mapping(code_to_name)
    by_code = names.select(F.col("src").alias("__code"), F.col("dst").alias("__name_code"))
    by_label = names.select(F.col("src").alias("label"), F.col("dst").alias("__name_label"))
    out = out.join(by_code, "__code", "left").join(by_label, "label", "left")
    blank = F.lit("")
    return out.withColumn(
        "label",
        F.coalesce(
            F.nullif(F.col("__name_code"), blank), F.nullif(F.col("__name_label"), blank), F.col("__code")
        ),
    ).drop("__code", "__name_code", "__name_label")


def detection_sources(detections: DataFrame, recordings: DataFrame) -> DataFrame:
    """Recordings that have detections; a detection of an unknown recording is an error."""
    ids = detections.where(F.col("recording_id").isNotNull()).select("recording_id").distinct()
    known = recordings.select("recording_id", "source")
    require_none(
        ids.join(known, "recording_id", "left_anti").select(F.col("recording_id").cast("string")),
        "detections name recordings that are not in the window store",
    )
    return known.join(ids, "recording_id", "left_semi")


def result_table(rows: DataFrame, label: str) -> DataFrame:
    """Placed rows in the published column order: the fixed columns, then the extra ones.

    A table without channels gets channel 0.
    """
    fixed = {"dest", "mapped_source", "recording_id", "channel", "offset_s", label, "score", "class_idx",
             "classifier_name", "window_id", "window_idx", "source"}
    channel = F.col("channel") if "channel" in rows.columns else F.lit(0)
    return rows.select(
        "dest",
        F.col("mapped_source").alias("source"),
        channel.cast("int").alias("channel"),
        F.col("offset_s").alias("offset"),
        F.col(label).alias("label"),
        "score",
        *[c for c in rows.columns if c not in fixed],
    )


def classify_table(placed: DataFrame) -> DataFrame:
    """Staged detections, placed, in the published column order."""
    return result_table(require_columns(placed, STAGED_REQUIRED, "staged detections"), "species")
