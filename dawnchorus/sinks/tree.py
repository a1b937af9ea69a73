"""Published tables as files at the paths the user asked for: a data source with a two-phase commit.

Spark's own writers name a folder per partition value (``dest=...``) and the
files in it themselves. Here a destination is the path of a file below the
root. Tasks write to a staging folder; the commit then moves each destination
to its place. A destination whose rows came from one task is a single file,
one that several tasks wrote is a folder of that name with parts in key order;
Spark reads both by the same path.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

STAGING = "_staging"  # below the root; Spark's readers pass over it
_MOVERS = 16  # destinations put in place at a time
_ROWS = 1 << 16  # rows of a row group


@dataclass
class Staged(WriterCommitMessage):
    """The files of one task: (destination, staged file, rows), and the task's place in the order of keys."""

    task: int
    files: list[tuple[str, str, int]]


class DestinationTree(DataSource):
    """``df.write.format("destination_tree")`` with options ``path``, ``filetype`` and ``facts`` (JSON).

    Rows have a ``dest`` column, relative and without ``..``, and come ordered by it within a task.
    """

    @classmethod
    def name(cls) -> str:
        return "destination_tree"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if not overwrite:
            raise ValueError("destinations are replaced: write with mode('overwrite')")
        return TreeWriter(self.options["path"], self.options.get("filetype", "parquet"), json.loads(self.options.get("facts", "{}")))


class TreeWriter(DataSourceArrowWriter):
    def __init__(self, root: str, filetype: str, facts: dict[str, str]):
        if filetype not in ("parquet", "csv"):
            raise ValueError(f"unsupported file type {filetype!r}")
        self.root, self.filetype, self.facts = root.rstrip("/"), filetype, facts
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Staged:
        from pyspark import TaskContext

        system, root = _opened(self.root)
        folder = f"{root}/{STAGING}/{self.job}/{uuid.uuid4().hex}"  # an attempt of its own: a repeated task shares nothing
        system.create_dir(folder, recursive=True)
        files, dest, out = [], None, None
        for batch in iterator:
            for value, part in _runs(batch):
                if out is None or value != dest:
                    if out is not None:
                        files.append((dest, out.path, out.close()))
                    dest, out = value, _File(system, f"{folder}/{len(files)}", part.schema, self.filetype, self.facts)
                out.add(part)
        if out is not None:
            files.append((dest, out.path, out.close()))
        return Staged(TaskContext.get().partitionId(), files)

    def commit(self, messages: list) -> None:
        system, root = _opened(self.root)
        plan: dict[str, list[str]] = {}
        for message in sorted((m for m in messages if m is not None), key=lambda m: m.task):
            for dest, path, _ in message.files:
                plan.setdefault(dest, []).append(path)
        note = f"{root}/{STAGING}/{self.job}/moves.json"
        system.create_dir(f"{root}/{STAGING}/{self.job}", recursive=True)
        with system.open_output_stream(note) as f:
            f.write(json.dumps(plan).encode())
        _put_in_place(system, root, plan, self.filetype)
        system.delete_dir(f"{root}/{STAGING}/{self.job}")

    def abort(self, messages: list) -> None:
        system, root = _opened(self.root)
        _gone(system, f"{root}/{STAGING}/{self.job}")


class _File:
    """One staged file, written batch by batch."""

    def __init__(self, system, path: str, schema, filetype: str, facts: dict[str, str]):
        import pyarrow.csv as pc
        import pyarrow.parquet as pq

        self.path, self.rows = path, 0
        self.stream = system.open_output_stream(path)
        if filetype == "parquet":
            noted = schema.with_metadata({k: str(v) for k, v in facts.items()})
            narrow = [f.name for f in schema if not _wide(f)]
            self.schema = noted
            self.writer = pq.ParquetWriter(self.stream, noted, compression="snappy", use_dictionary=narrow)
        else:
            self.schema = schema
            self.writer = pc.CSVWriter(self.stream, schema, write_options=pc.WriteOptions(quoting_style="needed"))

    def add(self, batch) -> None:
        self.rows += batch.num_rows
        self.writer.write_batch(batch.cast(self.schema) if self.schema.metadata else batch)

    def close(self) -> int:
        self.writer.close()
        if not self.stream.closed:
            self.stream.close()
        return self.rows


def _wide(field) -> bool:
    """Columns in which no value repeats: dictionaries cost time there and save nothing."""
    import pyarrow.types as pt

    return pt.is_floating(field.type) or pt.is_nested(field.type) or field.name == "embeddings"


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _runs(batch):
    """(destination, rows without that column) of each run of a destination."""
    import numpy as np

    at = batch.schema.get_field_index("dest")
    values = batch.column(at)
    if values.null_count:
        raise ValueError("a row has no destination")
    body = batch.remove_column(at)
    coded = values.dictionary_encode()
    codes = coded.indices.to_numpy()
    starts = np.flatnonzero(np.diff(codes, prepend=-1)).tolist()
    for first, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield values[first].as_py(), body.slice(first, end - first)


def _put_in_place(system, root: str, plan: dict[str, list[str]], filetype: str) -> None:
    def place(item) -> None:
        from pyarrow import fs

        dest, files = item
        if dest.startswith("/") or ".." in dest.split("/") or dest.split("/")[0] == STAGING or not dest.strip("/"):
            raise ValueError(f"unsafe destination {dest!r}")
        staged = [f for f in system.get_file_info(files) if f.type == fs.FileType.File]
        if not staged:  # moved by an earlier attempt at this commit
            return
        target = f"{root}/{dest}"
        if len(files) == 1:
            _gone(system, target)
            system.create_dir(target.rsplit("/", 1)[0], recursive=True)
            system.move(files[0], target)
            return
        if len(staged) == len(files):  # else the folder is already the new one
            _gone(system, target)
        system.create_dir(target, recursive=True)
        for k, path in enumerate(files):
            if any(f.path == path for f in staged):
                system.move(path, f"{target}/part-{k:05d}.{filetype}")

    with ThreadPoolExecutor(_MOVERS) as pool:
        list(pool.map(place, plan.items()))


def _gone(system, path: str) -> None:
    from pyarrow import fs

    kind = system.get_file_info(path).type
    if kind == fs.FileType.Directory:
        system.delete_dir(path)
    elif kind == fs.FileType.File:
        system.delete_file(path)


def write_tree(rows: DataFrame, root: str, filetype: str = "parquet", facts: dict[str, str] | None = None) -> None:
    """Write rows (with ``dest``, ordered by it in every partition) to files at their destinations below ``root``.

    Only destinations present in ``rows`` are replaced. A failed task leaves
    all former files; a driver lost while it puts files in place leaves a note, from which :func:`recover`
    finishes. ``facts`` become key-value metadata of every Parquet file.
    """
    spark = rows.sparkSession
    spark.dataSource.register(DestinationTree)
    options = {"path": root, "filetype": filetype, "facts": json.dumps(facts or {})}
    rows.write.format("destination_tree").options(**options).mode("overwrite").save()


def recover(root: str, filetype: str = "parquet") -> list[str]:
    """Finish commits that stopped half-way and delete staged files of others; the jobs that were finished.

    Not while another job writes below ``root``.
    """
    from pyarrow import fs

    system, inside = _opened(root.rstrip("/"))
    folder = f"{inside}/{STAGING}"
    done = []
    if system.get_file_info(folder).type != fs.FileType.Directory:
        return done
    for job in system.get_file_info(fs.FileSelector(folder)):
        note = f"{job.path}/moves.json"
        if system.get_file_info(note).type == fs.FileType.File:
            with system.open_input_stream(note) as f:
                _put_in_place(system, inside, json.loads(f.read()), filetype)
            done.append(job.base_name)
        system.delete_dir(job.path)
    return done


def read_destination(spark: SparkSession, root: str, dest: str, filetype: str = "parquet", schema: str | None = None) -> DataFrame:
    """The table at one destination, be it a file or a folder of parts."""
    reader = spark.read.option("header", True).option("nullValue", "\u0000").option("emptyValue", "").option("escape", '"')
    reader = reader.schema(schema) if schema else reader
    path = f"{root.rstrip('/')}/{dest}"
    return reader.parquet(path) if filetype == "parquet" else reader.csv(path)
