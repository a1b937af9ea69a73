"""The window store: recordings, windows, incremental additions, run summary."""

from __future__ import annotations

import json
import os
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from dawnchorus import shared
from dawnchorus.checks import require_none
from dawnchorus.functions.text import first_folder
from dawnchorus.sizing import parquet_options

WINDOW_KEY = ("recording_id", "window_idx", "channel")


def with_recordings(files: DataFrame, dataset: str) -> DataFrame:
    """Recording id, deployment and dataset of each relative path in ``source``.

    The deployment is the first folder, or the dataset for a file at the root.
    Ids are hashes, so that a rerun gives the same ones.
    """
    return files.select(
        F.xxhash64("source").alias("recording_id"),
        "*",
        F.coalesce(first_folder(F.col("source")), F.lit(dataset)).alias("deployment"),
        F.lit(dataset).alias("dataset"),
    )


def require_unique_ids(recordings: DataFrame) -> None:
    """Two different sources under one id would mix their windows."""
    pairs = recordings.select("recording_id", "source").distinct()
    shared = pairs.groupBy("recording_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("source").alias("a"), F.max("source").alias("b")
    )
    require_none(shared.where("n > 1"), "recording ids shared by several sources")


def one_id_per_source(recordings: DataFrame) -> bool:
    """Whether no source is listed under two ids."""
    per_source = recordings.groupBy("source").agg(F.min("recording_id").alias("a"), F.max("recording_id").alias("b"))
    return per_source.where("a <> b").isEmpty()


def unknown_recordings(windows: DataFrame, recordings: DataFrame) -> DataFrame:
    """Ids used by windows but absent from the recordings, with their window count."""
    counts = windows.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n_windows"))
    return counts.join(recordings.select("recording_id"), "recording_id", "left_anti")


def windows_by_source(windows: DataFrame, recordings: DataFrame) -> DataFrame:
    """Windows with the source of their recording; run the integrity check first."""
    names = recordings.select("recording_id", *[c for c in recordings.columns
                                                if c != "recording_id" and c not in windows.columns])
    return windows.join(names, "recording_id")


def require_known_recordings(windows: DataFrame, recordings: DataFrame) -> None:
    require_none(
        unknown_recordings(windows, recordings), "windows name recordings that are not in the store", KeyError
    )


def new_windows(incoming: DataFrame, existing: DataFrame, key=WINDOW_KEY) -> DataFrame:
    """Incoming windows that the store doesn't hold.

    The key has several columns, so a single large recording still spreads
    over all tasks; of the store only the key columns are read.
    """
    return incoming.join(existing.select(*key), list(key), "left_anti")


def known_windows(incoming: DataFrame, existing: DataFrame, key=WINDOW_KEY) -> DataFrame:
    return incoming.join(existing.select(*key), list(key), "left_semi")


def join_on(left: DataFrame, right: DataFrame, names: list[str], how: str) -> DataFrame:
    """Join on columns of the same names, null equal to null; only for semi and anti joins."""
    left, right = left.alias("l"), right.alias("r")
    return left.join(right, reduce(and_, [F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}")) for n in names]), how)


class ConcurrentAddition(RuntimeError):
    """Another writer committed to the store first; nothing of the refused addition is visible."""


LISTED = 10_000  # (addition, deployment) pairs that are named in a partition filter; beyond, they are joined


class WindowStore:
    """Recordings, windows and an index of them below one folder, added to in commits.

    An addition writes three tables under an id of its own: ``windows`` by
    deployment, ``recordings`` (those new to the store) and ``held`` (deployment,
    recording_id, n_windows of all its windows). It becomes visible by one small
    file in ``versions``, which names all additions up to it and is put in
    place by a rename that fails if that version exists. So a failed addition
    leaves the former store, both tables change at once, and of two writers that
    started from the same version one is refused.

    ``held`` says in which addition and deployment a recording has windows: only
    those partitions are read to find a window again.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    # -- versions ----------------------------------------------------------

    def _path(self, *names: str) -> str:
        return os.path.join(self.root, *names)

    def version(self) -> int:
        """The last committed version, 0 for an empty store."""
        names = shared.names(self.spark, self._path("versions"))
        return max([int(n) for n in names if n.isdigit()], default=0)

    def additions(self, version: int | None = None) -> list[str]:
        """Ids of the additions up to ``version`` (the last one), oldest first."""
        version = self.version() if version is None else version
        if version == 0:
            return []
        return json.loads(shared.read_text(self.spark, self._path("versions", f"{version:020d}")))["additions"]

    def _commit(self, base: int, additions: list[str]) -> None:
        """Make ``additions`` version ``base + 1``; refused if that version exists."""
        try:
            shared.put_once(self.spark, self._path("versions", f"{base + 1:020d}"), json.dumps({"additions": additions}))
        except FileExistsError as e:
            raise ConcurrentAddition(f"version {base + 1} of {self.root} was written by another addition") from e

    def remove_uncommitted(self) -> list[str]:
        """Delete what failed additions left behind; not while another writer is at work. Their ids."""
        known, gone = set(self.additions()), set()
        for table in ("windows", "recordings", "held"):
            for name in shared.names(self.spark, self._path(table)):
                if name.removeprefix("addition=") not in known:
                    shared.delete(self.spark, self._path(table, name))
                    gone.add(name.removeprefix("addition="))
        return sorted(gone)

    # -- tables ------------------------------------------------------------

    def _read(self, table: str, additions: list[str]) -> DataFrame | None:
        folders = [self._path(table, f"addition={a}") for a in additions]
        if not folders:
            return None
        reader = self.spark.read.option("basePath", self._path(table))
        found = next((schema for schema in map(self._schema, folders) if schema is not None), None)
        if found is None:  # additions without a single row of this table
            return None
        # partition values are text: a guessed type would turn 007 into 7
        fields = [T.StructField(f.name, T.StringType() if f.name in ("deployment", "addition") else f.dataType) for f in found]
        return reader.schema(T.StructType(fields)).parquet(*folders)

    def _schema(self, folder: str) -> T.StructType | None:
        try:
            return self.spark.read.option("basePath", os.path.dirname(folder)).parquet(folder).schema
        except AnalysisException as e:
            if "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def _table(self, table: str, version: int | None) -> DataFrame | None:
        found = self._read(table, self.additions(version))
        return None if found is None else found.drop("addition")

    @property
    def windows(self) -> DataFrame | None:
        return self._table("windows", None)

    @property
    def recordings(self) -> DataFrame | None:
        return self._table("recordings", None)

    def windows_at(self, version: int) -> DataFrame | None:
        return self._table("windows", version)

    def recordings_at(self, version: int) -> DataFrame | None:
        return self._table("recordings", version)

    def exists(self) -> bool:
        return self.version() > 0

    def counts(self) -> DataFrame:
        """Windows per deployment and recording, from the index alone."""
        held = self._read("held", self.additions())
        if held is None:
            return self.spark.createDataFrame([], "deployment string, recording_id long, n_windows long")
        return held.groupBy("deployment", "recording_id").agg(F.sum("n_windows").alias("n_windows"))

    def windows_of(self, ids: DataFrame, additions: list[str] | None = None) -> DataFrame | None:
        """Stored windows of the recordings in ``ids`` (recording_id), from the partitions that hold any; None if none does.

        The index is joined with the ids; the additions and deployments it
        names become a filter on partitions, so no other file is opened.
        """
        additions = self.additions() if additions is None else additions
        held = self._read("held", additions)
        if held is None:
            return None
        known = held.join(ids.select("recording_id").distinct(), "recording_id", "left_semi").select("addition", "deployment", "recording_id")
        places = known.select("addition", "deployment").distinct().limit(LISTED + 1).collect()
        if not places:
            return None
        windows = self._read("windows", additions if len(places) > LISTED else sorted({p["addition"] for p in places}))
        if len(places) <= LISTED:
            named = [p["deployment"] for p in places]
            among = F.col("deployment").isin([n for n in set(named) if n is not None])
            windows = windows.where(among | F.col("deployment").isNull() if None in named else among)
        known = known.select("deployment", "recording_id").distinct()
        return join_on(windows, known, ["deployment", "recording_id"], "left_semi")

    # -- additions ---------------------------------------------------------

    def add(self, recordings: DataFrame, windows: DataFrame, duplicates: str = "error", addition: str | None = None) -> int:
        """Add recordings and windows, which carry a ``deployment`` column, as one version; the number of windows added.

        Windows of recordings new to the store go in as they are. For a known
        recording ``duplicates`` decides: ``error`` refuses windows already
        held, ``skip`` leaves them out, ``allow`` adds them again. The checks
        hold against the version the addition started from; if another writer commits
        meanwhile, :class:`ConcurrentAddition` is raised and the call may be repeated.
        ``addition`` names the addition: one that the store already holds is not repeated.
        """
        if duplicates not in ("error", "skip", "allow"):
            raise ValueError("duplicates must be 'error', 'skip' or 'allow'")
        base = self.version()
        before = self.additions(base)
        if addition is not None and addition in before:
            return 0
        if duplicates == "error":
            twins = windows.groupBy(*WINDOW_KEY).count().where("count > 1").select(*WINDOW_KEY)
            require_none(twins, "windows repeated in the addition")
        elif duplicates == "skip":
            windows = windows.dropDuplicates(list(WINDOW_KEY))
        of_known = self.windows_of(windows.select("recording_id"), before) if duplicates != "allow" else None
        if of_known is not None:
            if duplicates == "error":
                again = known_windows(windows.select(*WINDOW_KEY), of_known)
                require_none(again, "windows already in the store")
            else:
                windows = new_windows(windows, of_known)
        fresh = recordings.dropDuplicates(["recording_id"])
        stored = self._read("recordings", before)
        if stored is not None:
            fresh = fresh.join(stored.select("recording_id"), "recording_id", "left_anti")
        name = addition or uuid.uuid4().hex
        fresh.write.mode("overwrite").parquet(self._path("recordings", f"addition={name}"))
        counted = Observation()
        out = windows.repartitionByRange("deployment", "recording_id")  # few files per deployment
        out = out.observe(counted, F.count(F.lit(1)).alias("n"))
        placed = self._path("windows", f"addition={name}")
        out.write.options(**parquet_options(out)).partitionBy("deployment").mode("overwrite").parquet(placed)
        own = self.spark.read.schema(out.schema).parquet(placed)
        index = own.groupBy("deployment", "recording_id").agg(F.count(F.lit(1)).alias("n_windows"))
        index.write.mode("overwrite").parquet(self._path("held", f"addition={name}"))
        self._commit(base, [*before, name])
        return counted.get["n"]


def summary_of(recordings: DataFrame, n_windows: int, elapsed_s: float) -> DataFrame:
    """The same from the recordings' lengths and a number of windows counted while they were written."""
    audio = recordings.agg(F.coalesce(F.sum("duration_s"), F.lit(0.0)).alias("audio_s"))
    return audio.select(
        F.lit(int(n_windows)).cast("long").alias("windows"),
        "audio_s",
        F.lit(float(elapsed_s)).alias("elapsed_s"),
        F.when(F.col("audio_s") > 0, F.lit(float(elapsed_s)) / F.nullif(F.col("audio_s") / 3600, F.lit(0.0))).alias("elapsed_s_per_audio_hour"),
    )


def run_summary(windows: DataFrame, audio_s: float, elapsed_s: float) -> DataFrame:
    """Windows produced, audio length, elapsed time, time per hour of audio."""
    hours = F.lit(float(audio_s)) / 3600
    return windows.agg(F.count(F.lit(1)).alias("windows")).select(
        "windows",
        F.lit(float(audio_s)).alias("audio_s"),
        F.lit(float(elapsed_s)).alias("elapsed_s"),
        F.when(hours > 0, F.lit(float(elapsed_s)) / F.nullif(hours, F.lit(0.0))).alias("elapsed_s_per_audio_hour"),
    )
