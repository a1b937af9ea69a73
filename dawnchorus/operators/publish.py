"""De-duplicated, sorted tables written one folder per destination."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dawnchorus.sinks.tree import write_tree
from dawnchorus.sizing import BROADCAST_BYTES, BROADCAST_ROWS, measured, parquet_options, row_bytes, written

SORT_FIRST = ("source", "offset")
PROVENANCE = "provenance"
_RANGE = "range number"


def deduplicate(rows: DataFrame, key: tuple[str, ...] | None = None) -> DataFrame:
    """Whole-row distinct.

    Copies collapse in the map-side half of the aggregate, so a row repeated
    very often doesn't travel. With ``key``, columns that tell most rows apart,
    the key columns alone are counted first: rows whose key doesn't repeat
    can't have an equal and are spared that shuffle. Repeated keys are
    broadcast where they are few, otherwise a filter of them
    (:func:`maybe_among`): only copies, and one row in a hundred or so that the filter
    takes for one, go through the distinct.
    """
    if key is None:
        return rows.dropDuplicates()
    again = repeated(rows, key)
    if again.isEmpty():
        return rows
    again = written(again)
    n, size = measured(again)
    if n > BROADCAST_ROWS or size > BROADCAST_BYTES:
        n = again.count()
        if n > FILTER_BYTES * 8 // BITS_PER_KEY:
            return rows.dropDuplicates()
        copy = maybe_among(rows, again, key, n)
        return rows.where(~copy).unionByName(rows.where(copy).dropDuplicates())
    left, right = rows.alias("l"), F.broadcast(again).alias("r")
    same = reduce(and_, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key])
    single = left.join(right, same, "left_anti")
    return single.unionByName(left.join(right, same, "left_semi").dropDuplicates())


FILTER_BYTES = 256 * 1024 * 1024  # what a task may hold of repeated keys: some 178 million
BITS_PER_KEY, PROBES = 12, 6
_SLOT_BITS = 23  # a slot of the filter is a megabyte


def _probes(hashes: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each hash, and its bits there."""
    h = hashes.view(np.uint64)
    spread = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    step = (spread >> np.uint64(32)) | np.uint64(1)
    bits = (spread[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64((1 << _SLOT_BITS) - 1)
    return (h >> np.uint64(11)) % np.uint64(slots), bits


def maybe_among(rows: DataFrame, keys: DataFrame, key: tuple[str, ...], n: int) -> Column:
    """A condition on ``rows``: true wherever the key is among ``keys``, and for about one other key in a hundred.

    A Bloom filter of ``n`` keys, made slot by slot in tasks and broadcast; its size is ``n`` times ``BITS_PER_KEY``.
    """
    slots = max(1, -(-n * BITS_PER_KEY >> _SLOT_BITS))

    def filled(table: pa.Table) -> pa.Table:
        hashes = table["hash"].to_numpy()
        mask = np.zeros(1 << _SLOT_BITS, dtype=bool)
        mask[_probes(hashes, slots)[1].ravel().astype(np.int64)] = True
        return pa.table([pa.array([table["slot"][0].as_py()], pa.int32()), pa.array([np.packbits(mask).tobytes()])], names=["slot", "bits"])

    hashed = keys.select(F.xxhash64(*key).alias("hash"))
    slot = F.pmod(F.shiftrightunsigned("hash", 11), F.lit(slots)).cast("int").alias("slot")
    parts = hashed.select("hash", slot).groupBy("slot").applyInArrow(filled, "slot int, bits binary").toArrow()
    held = np.zeros((slots, 1 << (_SLOT_BITS - 3)), dtype=np.uint8)
    for at, bits in zip(parts["slot"].to_pylist(), parts["bits"], strict=True):
        held[at] = np.frombuffer(bits.as_buffer(), dtype=np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(held)

    @F.pandas_udf("boolean")
    def among(hashes: pd.Series) -> pd.Series:
        where, bits = _probes(hashes.to_numpy(dtype=np.int64), slots)
        words = shared.value[where.astype(np.int64)[:, None], (bits >> np.uint64(3)).astype(np.int64)]
        return pd.Series(((words >> (7 - (bits & np.uint64(7)).astype(np.uint8))) & 1).all(axis=1))

    return among(F.xxhash64(*key))


def repeated(rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Keys that occur more than once; reads those columns only."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key)


def unique(rows: DataFrame, key: tuple[str, ...]) -> bool:
    return repeated(rows, key).isEmpty()


def sort_keys(rows: DataFrame) -> list:
    """Destination, source and offset, then the columns that make the order total."""
    names = [c for c in ("dest", *SORT_FIRST) if c in rows.columns]
    keys = [F.col(c) for c in names]
    if "score" in rows.columns:
        keys.append(F.desc("score"))
    rest = [f.name for f in rows.schema.fields
            if f.name in ("channel", "classifier_name", "label") and f.name not in names]
    return keys + [F.col(c) for c in rest]


TASK_BYTES = 32 * 1024 * 1024  # of rows as Spark holds them; a range holds about that much
TASK_ROWS = 50_000  # narrow rows are dealt to all cores from this many on
KEYS_PER_RANGE = 100  # sampled keys that a range's borders follow from


def _range_key(rows: DataFrame) -> Column:
    """The sort key as one value that ascends with it."""
    names = [c for c in ("dest", *SORT_FIRST) if c in rows.columns]
    keys = [F.col(c).alias(c) for c in names]
    if "score" in rows.columns:
        keys.append((-F.col("score")).alias("score"))
    rest = [f.name for f in rows.schema.fields if f.name in ("channel", "classifier_name", "label") and f.name not in names]
    return F.struct(*keys, *[F.col(c).alias(c) for c in rest])


def ranges_of(rows: DataFrame, partitions: int | None = None) -> tuple[int, str | None]:
    """How many ranges the rows are dealt to, and the lowest keys of all but the first, as JSON.

    Only key columns are read: the rows are counted, then a sample of keys, a
    hundred per range, is sorted. Vectors are looked at in a few rows, for their size.
    """
    total = rows.count()
    if partitions is None:
        few = rows.limit(50)
        width = few.agg(F.avg(row_bytes(few))).first()[0] or 0
        cores = rows.sparkSession.sparkContext.defaultParallelism
        partitions = max(1, math.ceil(total * width / TASK_BYTES), min(cores, total // TASK_ROWS))
    if partitions == 1 or total == 0:
        return 1, None
    keys = rows.select(_range_key(rows).alias("key"))
    share = min(1.0, partitions * KEYS_PER_RANGE / total)
    sample = (keys if share == 1.0 else keys.sample(share, seed=11)).agg(F.sort_array(F.collect_list("key")).alias("keys"))
    step = F.size("keys") / F.lit(partitions)
    borders = F.transform(F.sequence(F.lit(1), F.lit(partitions - 1)), lambda i: F.get("keys", F.floor(step * i).cast("int")))
    return partitions, sample.where(F.size("keys") > 0).select(F.to_json(borders)).first()[0]


def range_number(rows: DataFrame, partitions: int, borders: str | None) -> Column:
    """The range of each row: how many borders are not above its key, by binary search in one literal."""
    if borders is None:
        return F.lit(0)
    key = _range_key(rows)
    kind = rows.select(key.alias("key")).schema["key"].dataType
    held = F.from_json(F.lit(borders), T.ArrayType(kind))

    def halved(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        above = F.struct((middle + 1).alias("low"), s["high"].alias("high"))
        below = F.struct(s["low"].alias("low"), middle.alias("high"))
        return F.when(s["low"] >= s["high"], s).when(F.get(held, middle) <= key, above).otherwise(below)

    whole = F.struct(F.lit(0).alias("low"), F.lit(partitions - 1).alias("high"))
    return F.aggregate(F.array_repeat(F.lit(0), (partitions - 1).bit_length()), whole, halved, lambda s: s["low"])


def arrange(
    rows: DataFrame,
    partitions: int | None = None,
    encode: Callable[[DataFrame], DataFrame] | None = None,
    like: DataFrame | None = None,
) -> DataFrame:
    """Deal rows out by ranges of destination and sort key, then sort inside each.

    Small destinations share a task and give one file each; a destination (or a
    source) that holds most rows is split over many tasks, and its files follow
    each other in key order. The ranges come from a sample of the key columns of
    ``like`` (``rows`` before a costly step, or ``rows`` itself), so wide columns are read
    once, for the shuffle. ``encode`` runs behind the shuffle.
    """
    keys = sort_keys(rows)
    n, borders = ranges_of(rows if like is None else like, partitions)
    placed = rows.withColumn(_RANGE, range_number(rows, n, borders)).repartitionById(n, F.col(_RANGE)).drop(_RANGE)
    return (encode(placed) if encode else placed).sortWithinPartitions(*keys)


def with_provenance(rows: DataFrame, facts: dict[str, str] | None) -> DataFrame:
    """Attach facts about the run to the schema; Parquet keeps them in its footer."""
    if not facts:
        return rows
    first = next(f.name for f in rows.schema.fields if f.name != "dest")
    note = {PROVENANCE: {str(k): str(v) for k, v in facts.items()}}
    return rows.withColumn(first, F.col(first).alias(first, metadata=note))


def read_provenance(df: DataFrame) -> dict[str, str]:
    for f in df.schema.fields:
        if PROVENANCE in (f.metadata or {}):
            return dict(f.metadata[PROVENANCE])
    return {}


def publish(
    rows: DataFrame,
    root: str,
    filetype: str = "parquet",
    provenance: dict[str, str] | None = None,
    dedupe: bool = True,
    encode: Callable[[DataFrame], DataFrame] | None = None,
    project: Callable[[DataFrame], DataFrame] | None = None,
    partitions: int | None = None,
    max_records_per_file: int = 0,
    tree: bool = False,
) -> None:
    """Write ``rows`` (with a ``dest`` column) below ``root``, one folder per destination.

    With ``tree`` a destination is a file at its own path (a folder of parts where
    several tasks wrote it) and ``provenance`` are keys of the Parquet footers
    (:mod:`dawnchorus.sinks.tree`); otherwise it is a folder ``dest=<path>``.

    ``encode`` may call Python and runs before the final sort, ``project`` only
    selects column expressions and runs after it.

    Only destinations present in ``rows`` are replaced: files are staged by the
    commit protocol and swapped in when the job commits, so a lost task or a
    failed run leaves the former output.
    """
    if filetype not in ("parquet", "csv"):
        raise ValueError(f"unsupported file type {filetype!r}")
    out = arrange(deduplicate(rows) if dedupe else rows, partitions, encode, like=rows)
    if project is not None:
        out = project(out)
    if tree:
        write_tree(out, root, filetype, provenance)
        if filetype == "csv":
            _write_facts(rows.sparkSession, root, provenance)
        return
    writer = (
        with_provenance(out, provenance)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", max_records_per_file)
        .partitionBy("dest")
    )
    if filetype == "parquet":
        writer.options(**parquet_options(out)).option("compression", "snappy").parquet(root)
    else:
        writer.option("header", True).csv(root)
        _write_facts(rows.sparkSession, root, provenance)


def _write_facts(spark: SparkSession, root: str, facts: dict[str, str] | None) -> None:
    """CSV has no footer: the facts go to a side table that readers skip."""
    if facts:
        one = spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "value string")
        one.write.mode("overwrite").text(root.rstrip("/") + "/_provenance")


def read_published(
    spark: SparkSession, root: str, filetype: str = "parquet", schema: str | T.StructType | None = None
) -> DataFrame:
    """Published rows with their destination, typed by ``schema`` for CSV (no guessing).

    The CSV null mark is one no field can hold, so that ``""`` stays an empty
    text and only a missing field is null.
    """
    reader = spark.read.option("header", True).option("nullValue", "\u0000").option("emptyValue", "")
    if schema is not None:
        if isinstance(schema, str):
            schema = T.StructType.fromDDL(schema)
        if "dest" not in schema.fieldNames():
            schema = T.StructType([*schema.fields, T.StructField("dest", T.StringType())])
        reader = reader.schema(schema)
    return reader.parquet(root) if filetype == "parquet" else reader.csv(root)
