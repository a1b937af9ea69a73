"""Listings of audio files: discovery, depth rule, globs, statistics."""

from __future__ import annotations

import functools
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dawnchorus.functions.text import base_name, file_suffix, path_depth
from dawnchorus.sizing import written

# Recognised audio extensions.
AUDIO_EXTENSIONS = (".wav", ".flac", ".mp3", ".ogg")


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:/*"


_LEVEL = "path string, source string, outside boolean"


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """All audio files below ``root``, each once: path, source (relative), depth, length.

    Spark's file sources pass over names that start with ``_`` or ``.``, which
    recordings may have. Folders are therefore listed by tasks, one level of
    the tree at a time; each level is written, so no listing reaches the driver.
    The extension test ignores case.

    Links to folders outside the tree are followed, each such folder once however
    many links lead to it; folders of the tree itself are listed in their own
    place only, so a link to a parent or a neighbour adds nothing and no circle is walked.
    """
    if not re.match(_SCHEME, root):
        root = os.path.abspath(root)
    home = _identity(root)
    level = spark.createDataFrame([(root, "", False)], _LEVEL)
    levels, seen = [], None
    while True:
        listed = written(level.mapInArrow(_lister(home), "path string, source string, length long, folder boolean, identity string"))
        levels.append(listed.where("NOT folder").select("path", "source", "length"))
        folders = listed.where("folder")
        level = folders.where("identity IS NULL").select("path", "source", F.lit(False).alias("outside"))
        reached = folders.where("identity IS NOT NULL")
        if not reached.isEmpty():
            first = reached.groupBy("identity").agg(F.min_by(F.struct("path", "source"), "path").alias("at"))
            fresh = first if seen is None else first.join(seen, "identity", "left_anti")
            fresh = written(fresh.select("identity", "at.path", "at.source"))
            ids = fresh.select("identity")
            seen = ids if seen is None else seen.unionByName(ids)
            level = level.unionByName(fresh.select("path", "source", F.lit(True).alias("outside")))
        if level.isEmpty():
            break
        level = level.repartition("path")
    return with_depth(audio_only(functools.reduce(DataFrame.unionByName, levels)))


def _identity(path: str) -> str | None:
    """Where a path of this machine's file system leads when all links are followed; other systems have no links."""
    return None if re.match(_SCHEME, path) and not path.startswith("file:") else os.path.realpath(_plain(path))


def _lister(home: str | None):
    """Files and folders directly below each folder of a batch.

    ``identity`` is null for a folder in its own place in the tree; for one
    that a link leads to, outside the tree, it is the folder's real path.
    Folders of the tree that are met through a link, and links that lead nowhere, are left out.
    """

    def strange(inside: str, outside: bool) -> str | None:
        """The identity of a folder met through a link."""
        return os.path.realpath(inside) if home is not None and (outside or os.path.islink(inside)) else None

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        names = ["path", "source", "length", "folder", "identity"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string()]
        for batch in batches:
            for path, source, outside in zip(*[batch.column(c).to_pylist() for c in ("path", "source", "outside")], strict=True):
                system, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), _plain(path))
                found = [f for f in system.get_file_info(fs.FileSelector(inside)) if f.type != fs.FileType.NotFound]
                for at in range(0, len(found), 10_000):
                    rows = []
                    for f in found[at : at + 10_000]:
                        folder = f.type == fs.FileType.Directory
                        real = strange(f.path, outside) if folder else None
                        if real is not None and (real == home or real.startswith(home.rstrip("/") + "/")):
                            continue
                        rows.append((f"{path.rstrip('/')}/{f.base_name}", f"{source}/{f.base_name}".lstrip("/"), f.size, folder, real))
                    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def _plain(path: str) -> str:
    return re.sub(_SCHEME, "/", path)


def list_file(spark: SparkSession, path: str) -> DataFrame:
    """One audio file as a listing; its source is its name."""
    files = spark.read.format("binaryFile").load(path)
    return with_depth(audio_only(files.select("path", base_name(F.col("path")).alias("source"), "length")))


def audio_only(files: DataFrame, column: str = "source") -> DataFrame:
    """Files with an audio extension, whatever its case."""
    return files.where(F.lower(file_suffix(F.col(column))).isin(*AUDIO_EXTENSIONS))


def with_depth(files: DataFrame, column: str = "source") -> DataFrame:
    return files.withColumn("depth", path_depth(F.col(column)))


def depth_summary(files: DataFrame) -> DataFrame:
    """Shallowest depth, files at it and files skipped below it, as one row.

    Grouped by depth first: the groups are as few as the tree is deep.
    """
    per_depth = files.groupBy("depth").agg(F.count(F.lit(1)).alias("n"))
    low = per_depth.agg(F.min("depth").alias("depth"), F.sum("n").alias("n_all"), F.min_by("n", "depth").alias("n_kept"))
    return low.select("depth", "n_kept", (F.col("n_all") - F.col("n_kept")).alias("n_skipped"))


def at_shallowest_depth(files: DataFrame) -> tuple[DataFrame, str, int]:
    """Files at the shallowest depth, the glob of that depth, the number skipped."""
    row = depth_summary(files).first()
    if row["depth"] is None:
        raise FileNotFoundError("no audio files found")
    kept = files.where(F.col("depth") == F.lit(row["depth"]))
    return kept, "/".join(["*"] * row["depth"]), row["n_skipped"]


def glob_regex(glob: str) -> str:
    """An anchored pattern for a path glob; ``*`` and ``?`` stay inside one folder."""
    if "**" in glob:
        raise ValueError("recursive globs aren't supported; name the depth, e.g. '*/*'")
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        if ch == "*":
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif ch == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else "\\" + body if body[0] == "^" else body) + "]")
            i = end
        else:
            out.append("\\" + ch if not (ch.isalnum() or ch in "_/") else ch)
        i += 1
    return r"(?s)\A" + "".join(out) + r"\z"


def matching_glob(files: DataFrame, glob: str, column: str = "source") -> DataFrame:
    """Files whose whole relative path matches; a single file is the glob of its name."""
    return files.where(F.col(column).rlike(glob_regex(glob)))


def input_files(spark: SparkSession, root: str, glob: str | None = None) -> tuple[DataFrame, int]:
    """The files a run will process and their number.

    A root with an audio extension is a single file; otherwise the glob
    decides, or without one the depth rule.
    """
    if root.lower().endswith(AUDIO_EXTENSIONS):
        files = list_file(spark, root)
    elif glob:
        files = matching_glob(list_tree(spark, root), glob)
    else:
        files = at_shallowest_depth(list_tree(spark, root))[0]
    return files, files.count()


def manifest_statistics(manifest: DataFrame) -> DataFrame:
    """Number of files, total and average seconds; an unreadable file counts as 0."""
    seconds = F.coalesce(F.col("duration_s"), F.lit(0.0))
    return manifest.agg(
        F.count(F.lit(1)).alias("n_files"),
        F.coalesce(F.sum(seconds), F.lit(0.0)).alias("total_s"),
        F.coalesce(F.avg(seconds), F.lit(0.0)).alias("avg_s"),
    )
