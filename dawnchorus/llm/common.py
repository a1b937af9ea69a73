"""Scratch tables, grouped batches and connected components, shared by the operators."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="shared-")


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; only a local session may go without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.conf.get("spark.master", "local").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return root or _local_root()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    folder = os.path.join(scratch_root(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def documents_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only id and text, under fixed names, so that other columns can't clash."""
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    )


def join_same(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same names, null equal to null; the right side's copies are dropped."""
    other = right.withColumnsRenamed({n: f"right_{n}" for n in names})
    condition = F.lit(True)
    for n in names:
        condition = condition & F.col(n).eqNullSafe(F.col(f"right_{n}"))
    joined = left.join(other, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"right_{n}" for n in names])


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole groups from batches sorted by ``keys``, with the first row of each group and the end.

    Only the unfinished last group is held over to the next batch.
    """
    held: list[pa.Table] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        at, last = _borders(table, keys)
        first_key = tuple(table[k][0].as_py() for k in keys)
        if held and first_key != held_key:
            yield _with_borders(held, keys)
            held = []
        if len(at) == 2 and held:
            held.append(table)
        elif len(at) == 2:
            held = [table]
        else:
            yield _with_borders([*held, table.slice(0, at[-2])], keys)
            held = [table.slice(at[-2])]
        held_key = last
    if held:
        yield _with_borders(held, keys)


def _borders(table: pa.Table, keys: list[str]) -> tuple[list[int], tuple]:
    import numpy as np

    change = np.zeros(table.num_rows, dtype=bool)
    change[0] = True
    for k in keys:
        v = table[k].to_numpy(zero_copy_only=False)
        change[1:] |= v[1:] != v[:-1]
    at = [int(x) for x in np.flatnonzero(change)] + [table.num_rows]
    return at, tuple(table[k][table.num_rows - 1].as_py() for k in keys)


def _with_borders(tables: list[pa.Table], keys: list[str]) -> tuple[pa.Table, list[int]]:
    table = pa.concat_tables(tables).combine_chunks()
    return table, _borders(table, keys)[0]


def components(edges: DataFrame) -> DataFrame:
    """Root (smallest node) of every node that has an edge: (node, root) from (a, b).

    Alternating large-star and small-star rounds; each round is written to the
    shared folder, so neither lineage nor a lost executor repeats earlier ones.
    Minima are combined before the shuffle; joins on a hub are split by
    adaptive execution. Nodes may be of any type with an order.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        # large star: every larger neighbour of a node points to the node's smallest neighbour
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every smaller neighbour and the node itself point to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stored(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        sums = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_stored(now)
        if tuple(sums) == mark:
            roots = after.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.unionByName(after.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        now, mark = after, tuple(sums)
