"""Size checks for join sides and driver-side parameters."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from dawnchorus import shared

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024


def row_bytes(df: DataFrame):
    """Approximate bytes of one row as a Column (strings and arrays measured)."""
    total = F.lit(16)
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind == "string":
            total = total + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
        elif kind == "array":
            total = total + F.coalesce(F.size(F.col(f"`{f.name}`")), F.lit(0)) * 8
        else:
            total = total + 8
    return total.cast("long")


def measured(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[int, int]:
    """Row count and bytes of ``df``; counting stops just past ``max_rows``."""
    head = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(row_bytes(df)), F.lit(0)))
    rows, size = head.first()
    return rows, size


def broadcast_if_small(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Mark a join side for broadcast only after counting it.

    Meant for lists that come with the job (classes, species). Past the bound
    the frame is returned unmarked: the join then shuffles, and adaptive
    execution splits a skewed key. Tables that grow with the recordings are
    joined without a mark, so that Spark decides by the size it sees.
    """
    rows, size = measured(df, max_rows)
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df


_ROOT: ContextVar[str | None] = ContextVar("scratch root", default=None)


@contextmanager
def scratch_below(spark: SparkSession, root: str | None) -> Iterator[str]:
    """Scratch tables written inside go to a new folder below ``root``, which is deleted at the end.

    Without ``root`` the folder is made where :func:`scratch_folder` makes its own.
    Nothing that reads those tables may be handed out.
    """
    folder = f"{root.rstrip('/')}/scratch-{uuid.uuid4().hex}" if root else scratch_folder(spark)
    token = _ROOT.set(folder)
    try:
        yield folder
    finally:
        _ROOT.reset(token)
        shared.delete(spark, folder)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the one in use (:func:`scratch_below`) or the cluster's shared checkpoint folder.

    Only a local session may go without that setting; it gets a temporary one.
    """
    root = _ROOT.get() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="dawnchorus-")
    return os.path.join(root, f"scratch-{uuid.uuid4().hex}")


# Columns without repeated values: dictionaries cost time there and save nothing.
PACKED = ("embeddings", "beta")


def parquet_options(df: DataFrame) -> dict[str, str]:
    """Dictionary encoding for all columns but float32 ones, vectors and packed text.

    On a table with a column per vector element this made the write more than
    three times as fast, at the same size.
    """
    options = {"parquet.enable.dictionary": "false"}
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind not in ("float", "array", "struct", "map") and f.name not in PACKED:
            options[f"parquet.enable.dictionary#{f.name}"] = "true"
    return options


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a shared Parquet table and read it back.

    Cuts the lineage (a lost executor doesn't repeat model inference) and,
    unlike a cache, lets every reader fetch only the columns it needs.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write_scratch(df))


def written_counted(df: DataFrame, folder: str) -> tuple[DataFrame, int]:
    """Write ``df`` once to ``folder`` and read it back; its rows, counted while they were written."""
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("n"))
    counted.write.mode("overwrite").options(**parquet_options(df)).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), seen.get["n"]


def write_scratch(df: DataFrame) -> str:
    """Write ``df`` to a new scratch folder; the folder."""
    folder = scratch_folder(df.sparkSession)
    df.write.options(**parquet_options(df)).parquet(folder)
    return folder
