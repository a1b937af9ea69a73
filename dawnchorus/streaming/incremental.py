"""Incremental additions to the window store from a folder of window files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dawnchorus.operators.store import WindowStore


def add_arrivals(
    spark: SparkSession,
    arrivals: str,
    schema: str,
    store_root: str,
    checkpoint: str,
    duplicates: str = "skip",
):
    """Add window files that arrived since the last call, then stop.

    The stream's checkpoint remembers which files were taken. A batch repeated
    after a failure finds its windows in the store and, with ``skip``, adds
    nothing twice. Each file row carries its recording's columns.
    """

    def take(batch: DataFrame, _epoch: int) -> None:
        info = [c for c in ("recording_id", "source", "deployment", "dataset", "duration_s") if c in batch.columns]
        recordings = batch.select(*info).dropDuplicates(["recording_id"])
        drop = [c for c in ("dataset", "duration_s") if c in batch.columns]
        WindowStore(batch.sparkSession, store_root).add(recordings, batch.drop(*drop), duplicates)

    stream = spark.readStream.schema(schema).parquet(arrivals)
    query = (
        stream.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
