"""Linear recognizers over embeddings."""

from __future__ import annotations

import math
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnchorus.checks import require_none
from dawnchorus.schemas import require_columns
from dawnchorus.sizing import BROADCAST_BYTES, row_bytes

WEIGHT_COLUMNS = ("classifier_name", "class_idx", "label", "beta", "bias")


def misfits(windows: DataFrame, recognizers: DataFrame, vector: str = "embedding") -> DataFrame:
    """Recognizers whose dimension differs from a vector length: (classifier_name, dimension, width).

    Both sides shrink to their distinct lengths first. Reads the whole vector
    column: a job over a large store leaves the check to :func:`score`, which
    fails on a misfit before anything is published.
    """
    sized = windows.where(F.col(vector).isNotNull()).select(F.size(vector).alias("width"))
    lengths = sized.agg(F.collect_set("width")).scalar()  # one number per distinct length, all of them
    wanted = recognizers.select("classifier_name", F.size("beta").alias("dimension")).distinct()
    other = F.filter("lengths", lambda n: n != F.col("dimension"))
    return wanted.withColumn("lengths", lengths).select("classifier_name", "dimension", F.explode(other).alias("width"))


def require_compatible(windows: DataFrame, recognizers: DataFrame, vector: str = "embedding") -> None:
    """Every vector length must fit every recognizer; all misfits in one error."""
    bad = misfits(windows, recognizers, vector)
    rows = bad.orderBy("classifier_name", "width").collect()
    if rows:
        raise RuntimeError(
            "; ".join(
                f"{r['classifier_name']}: recognizer has dimension {r['dimension']}, embeddings have {r['width']}"
                for r in rows
            )
        )


def weight_blocks(recognizers: DataFrame, block_bytes: int = BROADCAST_BYTES):
    """Recognizer rows in blocks below a byte bound, one fetched at a time."""
    rows, size = recognizers.agg(F.count(F.lit(1)), F.sum(row_bytes(recognizers))).first()
    n = max(1, math.ceil((size or 0) / block_bytes))
    slot = F.pmod(F.xxhash64("classifier_name", "class_idx", "label"), F.lit(n))
    for k in range(n if rows else 0):
        block = recognizers.select(*WEIGHT_COLUMNS).where(slot == k)
        got = block.orderBy("classifier_name", "class_idx").collect()
        if got:
            yield got


def score(
    windows: DataFrame,
    recognizers: DataFrame,
    keep: list[str],
    vector: str = "embedding",
    min_score: float | None = None,
    activation: Callable[[np.ndarray], np.ndarray] | None = None,
    block_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``embedding . beta + bias`` for each window and recognizer class.

    A blocked matrix product in one scan of the windows: a task gathers a block
    of windows and multiplies it with one tile of weights after the other; only
    ``keep`` and the vector leave the JVM. No rows are paired by a join and
    nothing is shuffled. Without ``min_score`` there is a row for every window and
    class, as many as the caller asks for. Windows without a vector give no
    row. Tiles are fetched and broadcast one by one: the driver and a task hold
    one of them and a block of windows, whatever the weights' size; the rest lies
    on the executors' disks. Recognizers of several dimensions are an error before
    anything runs. The result has ``keep``, classifier_name, label and score.
    """
    require_columns(windows, [*keep, vector], "windows")
    fields = ", ".join(f"`{k}` {windows.schema[k].dataType.simpleString()}" for k in keep)
    schema = f"{fields}, classifier_name string, label string, score double"
    sizes = recognizers.select("classifier_name", F.size("beta").alias("dimension")).distinct()
    low, high = sizes.agg(F.min("dimension"), F.max("dimension")).first()
    if low is None:
        return windows.sparkSession.createDataFrame([], schema)
    if low != high:
        found = sorted((r["classifier_name"], r["dimension"]) for r in sizes.collect())
        raise ValueError("; ".join(f"{n}: recognizer has dimension {d}" for n, d in found))
    context = windows.sparkSession.sparkContext
    tiles = [Tile(context.broadcast(_tile(rows))) for rows in weight_blocks(recognizers, block_bytes)]
    narrow = windows.where(F.col(vector).isNotNull()).select(*keep, vector)
    return narrow.mapInArrow(_scorer(tiles, low, keep, vector, min_score, activation, block_bytes), schema)


class Tile:
    """Weights of some recognizer classes, in a task's memory only while opened."""

    def __init__(self, broadcast):
        self.broadcast = broadcast

    @contextmanager
    def opened(self, keep: bool = False):
        """(beta, bias, names, labels); ``keep`` leaves them in memory for the next time."""
        yield self.broadcast.value
        if not keep:
            vars(self.broadcast).pop("_value", None)  # read again from the executor's disk next time


def _tile(rows) -> tuple[np.ndarray, np.ndarray, list[str], list[str]]:
    beta = np.array([r["beta"] for r in rows], dtype="float64").T.copy()
    bias = np.array([r["bias"] for r in rows], dtype="float64")
    return beta, bias, [r["classifier_name"] for r in rows], [r["label"] for r in rows]


ROWS_OUT = 4_000_000  # scores held at once


def _scorer(tiles, dimension, keep, vector, min_score, activation, block_bytes=BROADCAST_BYTES):
    def fitting(batch):
        sizes = np.unique(batch.column(vector).value_lengths().to_numpy(zero_copy_only=False))
        if any(sizes != dimension):
            names = set()
            for tile in tiles:
                with tile.opened() as (_, _, found, _):
                    names |= set(found)
            wrong = f"recognizer has dimension {dimension}, embeddings have {sizes.tolist()}"
            raise ValueError("; ".join(f"{n}: {wrong}" for n in sorted(names)))

    def scored(batch, beta, bias, names, labels):
        flat = batch.column(vector).flatten().to_numpy(zero_copy_only=False)
        scores = flat.astype("float64").reshape(batch.num_rows, dimension) @ beta + bias
        if activation is not None:
            scores = activation(scores)
        window, cls = np.nonzero(np.ones(scores.shape, bool) if min_score is None else scores >= min_score)
        take, pick = pa.array(window), pa.array(cls)
        arrays = [batch.column(k).take(take) for k in keep]
        arrays += [pa.array(names, pa.string()).take(pick), pa.array(labels, pa.string()).take(pick)]
        return pa.RecordBatch.from_arrays(
            [*arrays, pa.array(scores[window, cls])], names=[*keep, "classifier_name", "label", "score"]
        )

    def blocks(batches):
        """Batches gathered up to the bytes of a tile, so that each tile read is worth a whole block."""
        held, size = [], 0
        for batch in batches:
            fitting(batch)
            held.append(batch)
            size += batch.num_rows * dimension * 4
            if len(tiles) == 1 or size >= block_bytes:
                yield held
                held, size = [], 0
        if held:
            yield held

    def run(batches):
        for block in blocks(batches):
            for tile in tiles:
                with tile.opened(keep=len(tiles) == 1) as weights:
                    step = max(1, ROWS_OUT // len(weights[2]))
                    for batch in block:
                        for at in range(0, batch.num_rows, step):
                            yield scored(batch.slice(at, step), *weights)

    return run


def require_unique_names(recognizers: DataFrame) -> None:
    """A (classifier, class position) pair must be defined once."""
    twice = recognizers.groupBy("classifier_name", "class_idx").count().where("count > 1")
    require_none(twice, "recognizer classes defined more than once")
