"""Whole jobs: embedding export, classification, recognizers, and all in one.

Each job is one lazy plan to a routed table (``*_rows``) plus a function that
checks the sources and publishes it. The checks read source columns only, never
vectors or logits.
"""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dawnchorus import shared
from dawnchorus.checks import SHOWN
from dawnchorus.functions.vectors import as_float32, first_width, pack, widen
from dawnchorus.operators import classify, labels, publish, recognize, routing, store
from dawnchorus.operators.framing import HOP_S, WINDOW_S, shard_recordings, spread_shards
from dawnchorus.operators.inference import infer
from dawnchorus.operators.sourcemap import (
    EXTRA_COLUMNS,
    SourceMap,
    map_sources,
    present_extras,
    require_mapped,
    require_pattern_for_many,
)
from dawnchorus.plans.ledger import Ledger, NoLedger, fingerprint, run_key
from dawnchorus.sizing import scratch_below, written, written_counted


@dataclass(frozen=True)
class Output:
    """Where and how one kind of table is published; ``tree`` puts files at the rendered paths themselves."""

    root: str
    filetype: str = "parquet"
    template: str | None = None
    layout: str | None = None
    provenance: dict[str, str] = field(default_factory=dict)
    tree: bool = False

    @property
    def path_template(self) -> str:
        return routing.resolve_layout(self.template, self.layout)


WINDOW_KEY = ("recording_id", "channel", "offset_s")
Translation = Callable[[DataFrame], DataFrame]


def mapped_recordings(recordings: DataFrame, smap: SourceMap | None, extra=EXTRA_COLUMNS) -> DataFrame:
    """recording_id, source, mapped_source and those extra columns any source has."""
    mapped = map_sources(recordings.select("recording_id", "source"), smap, extra)
    names = [c for c in mapped.columns if c not in ("recording_id", "source", "mapped_source")]
    present = present_extras(mapped, names)
    return mapped.drop(*[n for n in names if n not in present])


def _flatten(rows: DataFrame, flatten_channel: bool) -> DataFrame:
    return rows.withColumn("channel", F.lit(0)) if flatten_channel else rows


def _distinct_before_join(rows: DataFrame, mapped: DataFrame, key=None) -> tuple[DataFrame, bool]:
    """Distinct rows while they carry an id instead of paths and links.

    The published columns follow from the recording, and no two sources share
    a published value (checked), so equal published rows are equal here. Only
    if a source has two ids must the distinct wait for the published rows.
    """
    if not store.one_id_per_source(mapped):
        return rows, False
    return publish.deduplicate(rows, key), True


def _carried(df: DataFrame, *columns: str, kind: str = "") -> list[str]:
    """The named columns, ``source`` where the rows carry it, and the route of one kind of table (:func:`routed`)."""
    names = [c for c in ("source", "mapped_source", f"dest_{kind}", *_extra_carried(df)) if c in df.columns]
    return [*columns, *[n for n in names if n not in columns]]


_EXTRA = "extra_"  # extra columns of a source, as rows carry them
_CLASSIFIER = "\x01"  # stands for the recognizer's name in a route made before it is known


def _extra_carried(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(_EXTRA)]


def routed(
    recordings: DataFrame,
    smap: SourceMap | None = None,
    embed: Output | None = None,
    classification: Output | None = None,
    recognition: Output | None = None,
    table_format: str = "serialized",
    extra=EXTRA_COLUMNS,
) -> DataFrame:
    """Recordings with their published source, extra columns and destinations.

    :func:`model_windows` hands these columns on to the windows, so that paths and file-name
    patterns are worked out once per recording and not once per window.
    """
    mapped = map_sources(recordings.select("recording_id", "source"), smap, extra)
    names = [c for c in mapped.columns if c not in ("recording_id", "source", "mapped_source")]
    out = mapped.withColumnsRenamed({n: _EXTRA + n for n in names})
    source = F.col("source")
    if embed is not None:
        dest = routing.destination(source, embed.path_template, "embeddings", embed.filetype, table_format)
        out = out.withColumn("dest_embeddings", dest)
    if classification is not None:
        out = out.withColumn("dest_classify", routing.destination(source, classification.path_template, "classify", classification.filetype))
    if recognition is not None:
        dest = routing.destination(source, recognition.path_template, "recognizer", recognition.filetype, classifier_name=F.lit(_CLASSIFIER))
        out = out.withColumn("dest_recognizer", dest)
    return recordings.join(out.drop("source"), "recording_id")


def place(
    rows: DataFrame, mapped: DataFrame, smap: SourceMap | None, dest_of: Callable[[Column], Column], kind: str
) -> DataFrame:
    """Add ``dest``, ``mapped_source`` and the extra columns; drop the plain source.

    Rows that carry their route (:func:`routed`) have them already. Rows that carry their source need no join: the columns are expressions of
    it, and vectors aren't shuffled to meet the recordings. Other rows are
    joined by recording id, with everything rendered once per recording before;
    so are rows whose file-name pattern needs Python.
    """
    extras = [c for c in mapped.columns if c not in ("recording_id", "source", "mapped_source")]
    source = F.col("source")
    smap = smap or SourceMap()
    if {"mapped_source", f"dest_{kind}"} <= set(rows.columns) and {_EXTRA + n for n in extras} <= set(rows.columns):
        dest = F.col(f"dest_{kind}")
        if "classifier_name" in rows.columns:
            dest = F.replace(dest, F.lit(_CLASSIFIER), F.col("classifier_name"))
        unused = [n for n in _extra_carried(rows) if n.removeprefix(_EXTRA) not in extras]
        named = rows.withColumn("dest", dest).drop("source", f"dest_{kind}", *unused)
        return named.withColumnsRenamed({_EXTRA + n: n for n in extras})
    rows = rows.drop("mapped_source", f"dest_{kind}", *_extra_carried(rows))
    if "source" in rows.columns and smap.compiled:
        found = smap.extra_columns(source, extras)
        columns = {"mapped_source": smap.mapped(source), "dest": dest_of(source)}
        return rows.withColumns(columns | {n: found[n] for n in extras}).drop("source")
    rows = rows.drop("source")
    if "classifier_name" in rows.columns:
        return rows.join(mapped, "recording_id").withColumn("dest", dest_of(source)).drop("source")
    return rows.join(mapped.withColumn("dest", dest_of(source)).drop("source"), "recording_id")


# --- embeddings -----------------------------------------------------------


def embedding_rows(
    windows: DataFrame,
    mapped: DataFrame,
    smap: SourceMap | None = None,
    table_format: str = "serialized",
    template: str = routing.LAYOUTS["flat"],
    filetype: str = "parquet",
) -> DataFrame:
    """dest, source, channel, offset and the vector as an array."""
    narrow = windows.select(*_carried(windows, "recording_id", "channel", "offset_s", "embedding", kind="embeddings"))
    named = place(
        narrow, mapped, smap,
        lambda source: routing.destination(source, template, "embeddings", filetype, table_format), "embeddings",
    )
    return named.select(
        "dest",
        F.col("mapped_source").alias("source"),
        F.col("channel").cast("int").alias("channel"),
        F.col("offset_s").alias("offset"),
        as_float32(F.col("embedding")).alias("embedding"),
    )


def format_vectors(rows: DataFrame, table_format: str = "serialized", width: int | None = None) -> DataFrame:
    """The vector packed as text (``serialized``) or as one column per element (``columns``)."""
    if table_format == "serialized":
        return pack(rows, "embedding", "embeddings").drop("embedding")
    if table_format == "columns":
        return widen(rows, "embedding", width)
    raise ValueError("table_format must be 'serialized' or 'columns'")


def export_embeddings(
    windows: DataFrame,
    recordings: DataFrame,
    output: Output,
    table_format: str = "serialized",
    smap: SourceMap | None = None,
    flatten_channel: bool = False,
) -> None:
    """Publish the embeddings table.

    Vectors stay arrays through the shuffle and the sort and take their output
    form late: text before the last sort, columns after it.
    """
    mapped = _checked_recordings(windows, recordings, smap, ())
    dest = routing.destination(F.col("source"), output.path_template, "embeddings", output.filetype, table_format)
    _require_safe_destinations(mapped, dest)
    narrow = windows.select(*_carried(windows, "recording_id", "channel", "offset_s", "embedding", kind="embeddings"))
    narrow, done = _distinct_before_join(_flatten(narrow, flatten_channel), mapped, WINDOW_KEY)
    rows = embedding_rows(narrow, mapped, smap, table_format, output.path_template, output.filetype)
    if table_format == "serialized":
        late = {"encode": lambda df: format_vectors(df, "serialized")}
    else:
        width = first_width(windows, "embedding")
        late = {"project": lambda df: format_vectors(df, table_format, width)}
    publish.publish(rows, output.root, output.filetype, output.provenance, dedupe=not done, tree=output.tree, **late)


# --- classification -------------------------------------------------------


def known_species(species: DataFrame, classes: DataFrame) -> DataFrame:
    """The species list (raw, item_ord) itself; blank lists and names that no class has are errors."""
    listed = species.where(F.length(F.trim("raw")) > 0)
    if listed.isEmpty():
        raise ValueError("the species list is empty")
    ordered = listed if "item_ord" in listed.columns else listed.withColumn("item_ord", F.lit(0))
    names = classes.select("label", F.col("class_idx").alias("ord"))
    labels.require_all_known(labels.canonicalize(ordered, names), "classes")
    return listed


def translated_species(species: DataFrame, translate: Translation, label_space: str = "classes") -> DataFrame:
    """A species list in the classes' names, each once at its first place: (raw, item_ord).

    ``translate`` maps the list (raw, item_ord) to (raw, label), as the
    translations of :mod:`dawnchorus.operators.labels` do. Entries it has no label
    for are left out with a warning; a list of which nothing is left is an error.
    """
    listed = species.where(F.length(F.trim("raw")) > 0)
    ordered = listed if "item_ord" in listed.columns else listed.withColumn("item_ord", F.lit(0))
    found = written(translate(ordered).select("raw", "label"))
    labels.require_any(found, label_space)
    missed = labels.unmatched(ordered, found).select("raw", "item_ord").orderBy("item_ord").limit(SHOWN + 1).collect()
    if missed:
        shown = ", ".join(repr(r["raw"]) for r in missed[:SHOWN])
        more = " and more" if len(missed) > SHOWN else ""
        warnings.warn(f"species list entries unknown to {label_space}: {shown}{more}", UserWarning, stacklevel=2)
    return labels.translated_list(ordered, found).select(F.col("label").alias("raw"), "item_ord")


def detections(
    windows: DataFrame,
    classes: DataFrame,
    threshold: float = classify.DEFAULT_THRESHOLD,
    top_n: int | None = classify.DEFAULT_TOP_N,
    species: DataFrame | None = None,
    translate: Translation | None = None,
) -> DataFrame:
    """Staged detections from windows with a logit array, in one pass over the logits.

    ``translate`` brings the species list into the classes' names before it is
    validated (:func:`translated_species`); without it, entries are class names.
    """
    width = classes.count()
    kept = windows.select(*_carried(windows, "recording_id", "channel", "offset_s", "logits", kind="classify"))
    allowed = None
    if species is not None:
        if translate is not None:
            species = translated_species(species, translate)
        allowed = classify.allowed_classes(classes, known_species(species, classes))
    found = classify.top_classes(kept, "logits", threshold, top_n, allowed, width)
    named = classify.name_classes(found, classes)
    return named.withColumnRenamed("label", "species")


def detection_rows(
    found: DataFrame,
    mapped: DataFrame,
    smap: SourceMap | None = None,
    template: str = routing.LAYOUTS["flat"],
    filetype: str = "csv",
) -> DataFrame:
    """dest, source, channel, offset, label, score and the extra columns."""
    known = found.where(F.col("recording_id").isNotNull())
    named = place(known, mapped, smap, lambda source: routing.destination(source, template, "classify", filetype), "classify")
    return classify.classify_table(named)


def export_classification(
    found: DataFrame,
    recordings: DataFrame,
    output: Output,
    smap: SourceMap | None = None,
    flatten_channel: bool = False,
) -> None:
    """Publish detections. Only sources with detections take part in the checks.

    Detections are few against logits: they are staged once, and the checks and
    the export read that table instead of the logits.
    """
    found = written(found)
    sources = classify.detection_sources(found, recordings)
    mapped = written(mapped_recordings(sources, smap))
    routing.require_safe(mapped)
    require_mapped(mapped, smap)
    dest = routing.destination(F.col("source"), output.path_template, "classify", output.filetype)
    _require_safe_destinations(mapped, dest)
    if flatten_channel or "channel" not in found.columns:
        found = found.withColumn("channel", F.lit(0))
    narrow = found.select(*_carried(found, "recording_id", "channel", "offset_s", "species", "score", kind="classify"))
    narrow, done = _distinct_before_join(narrow, mapped)
    rows = detection_rows(narrow, mapped, smap, output.path_template, output.filetype)
    publish.publish(rows, output.root, output.filetype, output.provenance, dedupe=not done, tree=output.tree)


# --- recognizers ----------------------------------------------------------


def recognizer_rows(
    scored: DataFrame,
    mapped: DataFrame,
    smap: SourceMap | None = None,
    template: str = routing.LAYOUTS["flat"],
    filetype: str = "csv",
) -> DataFrame:
    """dest, source, channel, offset, label, score and the extra columns of scored windows."""
    if "{classifier_name}" not in template:
        scored = scored.drop("classifier_name")

    def dest_of(source):
        return routing.destination(
            source, template, "recognizer", filetype, classifier_name=F.col("classifier_name")
        )

    return classify.result_table(place(scored, mapped, smap, dest_of, "recognizer"), "label")


def run_recognizers(
    windows: DataFrame,
    recordings: DataFrame,
    recognizers: DataFrame,
    output: Output,
    smap: SourceMap | None = None,
    flatten_channel: bool = False,
    min_score: float | None = None,
    activation: Callable | None = None,
) -> None:
    """Publish the scores of all recognizers.

    Vectors are read and multiplied once: scores are staged as narrow rows, and
    the sampling for the sort and the join run on those. A misfitting recognizer
    fails that first step, before anything is published. Scores are distinct if
    windows and labels are, which is far cheaper to see than on the scores.
    """
    recognize.require_unique_names(recognizers)
    mapped = _checked_recordings(windows, recordings, smap)
    keep = _carried(windows, *WINDOW_KEY, kind="recognizer")
    scored = recognize.score(windows, recognizers, keep, "embedding", min_score, activation)
    scored = written(scored)
    pairs = scored.select("recording_id", "classifier_name").distinct()
    dest = routing.destination(
        F.col("source"), output.path_template, "recognizer", output.filetype, classifier_name=F.col("classifier_name")
    )
    _require_safe_destinations(pairs.join(mapped, "recording_id"), dest)
    narrow, visible = _flatten(scored, flatten_channel), ("classifier_name", "label")
    if "{classifier_name}" not in output.path_template:
        narrow, visible = narrow.drop("classifier_name"), ("label",)
    surely = publish.unique(recognizers, visible) and publish.unique(_flatten(windows, flatten_channel), WINDOW_KEY)
    if surely and store.one_id_per_source(mapped):
        done = True
    else:
        narrow, done = _distinct_before_join(narrow, mapped)
    rows = recognizer_rows(narrow, mapped, smap, output.path_template, output.filetype)
    publish.publish(rows, output.root, output.filetype, output.provenance, dedupe=not done, tree=output.tree)


def _require_safe_destinations(rows: DataFrame, dest: Column) -> None:
    """Checks distinct destinations, written first: a filter on the expression itself would be copied into it."""
    routing.require_safe(written(rows.select(dest.alias("dest")).distinct()), "dest")


def _checked_recordings(
    windows: DataFrame, recordings: DataFrame, smap: SourceMap | None, extra=EXTRA_COLUMNS
) -> DataFrame:
    """The recordings that have windows, mapped, written once and checked.

    A recording without windows (too short, say) publishes nothing, so its name
    is not judged.
    """
    store.require_known_recordings(windows, recordings)
    used = recordings.join(windows.select("recording_id").distinct(), "recording_id", "left_semi")
    mapped = written(mapped_recordings(used, smap, extra))
    routing.require_safe(mapped)
    require_mapped(mapped, smap)
    return mapped


# --- everything -----------------------------------------------------------


def model_windows(
    recordings: DataFrame,
    shard_samples: Callable[[DataFrame], DataFrame],
    load_model: Callable,
    with_logits: bool,
    window_s: float = WINDOW_S,
    hop_s: float = HOP_S,
    partitions: int | None = None,
    batch_size: int | None = None,
    frames: Callable[[int], int] | None = None,
) -> DataFrame:
    """Recordings to windows with vectors, each carrying its source.

    ``shard_samples`` adds a ``samples array<float>`` column to a table of
    shards (decoding audio is the caller's). The shuffle happens on the small
    shard rows, before samples exist. With ``batch_size`` the model takes that many
    shards a call, padded; ``frames`` tells a shard's own frames (:func:`infer`).
    """
    shards = spread_shards(shard_recordings(recordings), partitions)
    route = _route_columns(recordings)
    keys = ["recording_id", "source", "deployment", "shard_idx", "shard_offset_s", *route]
    rows = infer(shard_samples(shards).select(*keys, "samples"), load_model, "samples", keys, with_logits,
                 batch_size=batch_size, frames=frames)
    per_shard = max(1, -int(-60.0 // hop_s))
    start = F.col("shard_offset_s") + F.col("t") * F.lit(float(hop_s))
    return rows.select(
        "recording_id",
        "source",
        "deployment",
        (F.col("shard_idx") * per_shard + F.col("t")).cast("int").alias("window_idx"),
        "channel",
        start.alias("offset_s"),
        (start + F.lit(float(window_s))).alias("end_s"),
        "embedding",
        *(["logits"] if with_logits else []),
        *route,
    )


def analyze(
    spark: SparkSession,
    recordings: DataFrame,
    windows: DataFrame,
    embed: Output | None = None,
    table_format: str = "serialized",
    classification: Output | None = None,
    classes: DataFrame | None = None,
    species: DataFrame | None = None,
    threshold: float = classify.DEFAULT_THRESHOLD,
    top_n: int | None = classify.DEFAULT_TOP_N,
    recognition: Output | None = None,
    recognizers: DataFrame | None = None,
    smap: SourceMap | None = None,
    store_root: str | None = None,
    duplicates: str = "error",
    stage: bool = True,
    translate: Translation | None = None,
    work: str | None = None,
    resume: str | None = None,
) -> DataFrame:
    """Any of the three exports over one window table; returns the run summary.

    ``windows`` may come straight from :func:`model_windows`: it is written
    once into a scratch table, so that the model runs once, and every export
    reads its own columns from there. Pass ``stage=False`` for windows that
    are a stored table already. With ``store_root`` the windows are added to
    that store; the embedding and recognizer tables then cover all of it, the
    classification only the windows of this run.

    ``work`` is the folder for scratch tables (by default the session's
    ``spark.checkpoint.dir``); those of this call are deleted at its end.
    ``resume`` names the run's model and settings that the arguments don't show:
    finished steps are then noted below ``work``, under a key made of it, the
    tables and the options, and a repeated call after a failure does only the rest, on
    the windows already staged, which stay in ``work`` until every step is done.
    """
    if embed is None and classification is None and recognition is None:
        raise ValueError("nothing to do: ask for embeddings, classification or recognizers")
    if classification is not None and classes is None:
        raise ValueError("classification needs the class list")
    if recognition is not None and recognizers is None:
        raise ValueError("recognition needs recognizers")
    if resume is not None and work is None:
        raise ValueError("a run that is to be resumed needs a work folder")
    began = time.monotonic()
    require_pattern_for_many(recordings.limit(2).count(), smap)
    store.require_unique_ids(recordings)
    ledger = NoLedger()
    if resume is not None:
        outputs = {k: o and asdict(o) for k, o in (("embed", embed), ("classify", classification), ("recognize", recognition))}
        key = run_key(
            resume=resume, outputs=outputs, table_format=table_format, threshold=threshold, top_n=top_n, store=store_root,
            duplicates=duplicates, smap=smap and repr(smap), translate=translate and getattr(translate, "__qualname__", repr(type(translate))),
            tables=[fingerprint(t) for t in (recordings, classes, species, recognizers)], stage=stage,
        )
        ledger = Ledger(spark, f"{work.rstrip('/')}/runs", key)
        if (before := ledger.done("finished")) is not None:
            return store.summary_of(recordings, before["n"], time.monotonic() - began)
    with scratch_below(spark, work) as scratch:
        staged = f"{ledger.folder}/windows-table" if resume is not None else f"{scratch}/windows"
        if stage:
            n = ledger.once("windows", lambda: {"n": written_counted(windows, staged)[1]})["n"]
            run = spark.read.schema(windows.schema).parquet(staged)
        else:
            run, n = windows, windows.count()
        everything, everyone = run, recordings
        if store_root is not None:
            kept = store.WindowStore(spark, store_root)
            body = run.drop("logits", *_route_columns(run))

            def addition() -> dict:
                kept.add(recordings, body, duplicates, addition=ledger.key)
                return {"version": kept.version()}

            version = ledger.once("store", addition)["version"]
            everything, everyone = kept.windows_at(version), kept.recordings_at(version)
        if embed is not None:
            ledger.once("embeddings", lambda: export_embeddings(everything, everyone, embed, table_format, smap))
        if recognition is not None:
            ledger.once("recognizers", lambda: run_recognizers(everything, everyone, recognizers, recognition, smap))
        if classification is not None:

            def classified() -> None:
                found = detections(run, classes, threshold, top_n, species, translate)
                export_classification(found, everyone, classification, smap)

            ledger.once("classification", classified)
        ledger.once("finished", lambda: {"n": n})
        if resume is not None and stage:
            shared.delete(spark, staged)
    return store.summary_of(recordings, n, time.monotonic() - began)


def _route_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c == "mapped_source" or c.startswith(("dest_", _EXTRA))]
