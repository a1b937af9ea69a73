"""What a run has finished, so that a repeated run does only the rest."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dawnchorus import shared


def fingerprint(table: DataFrame | None) -> str:
    """Rows and an order-free sum of row hashes; equal tables have equal ones, whatever their partitions."""
    if table is None:
        return "none"
    columns = sorted(table.columns)
    hashes = F.xxhash64(*[F.col(f"`{c}`") for c in columns]).cast("decimal(38,0)")
    n, total = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(hashes), F.lit(0).cast("decimal(38,0)"))).first()
    return f"{','.join(columns)}:{n}:{total}"


def run_key(**facts) -> str:
    """A name for a run that follows from its inputs and options."""
    return hashlib.sha256(json.dumps(facts, sort_keys=True, default=repr).encode()).hexdigest()[:40]


class Ledger:
    """Finished steps of one run: a file per step below ``root/<key>``, put in place whole.

    A step that failed, or whose driver was lost before the file stood, is done
    again; steps must therefore bear repetition (publishing replaces its destinations,
    additions to the store carry the run's key).
    """

    def __init__(self, spark: SparkSession, root: str, key: str):
        self.spark, self.folder, self.key = spark, f"{root.rstrip('/')}/{key}", key

    def done(self, step: str) -> dict | None:
        """What the step noted, or None if it isn't finished."""
        text = shared.read_text(self.spark, f"{self.folder}/{step}")
        return None if text is None else json.loads(text)

    def finish(self, step: str, **facts) -> dict:
        shared.put_once(self.spark, f"{self.folder}/{step}", json.dumps(facts))
        return facts

    def once(self, step: str, work: Callable[[], dict | None]) -> dict:
        """Do ``work`` unless the step is finished; what it noted."""
        before = self.done(step)
        return before if before is not None else self.finish(step, **(work() or {}))


class NoLedger:
    """For runs that are not to be resumed: every step is done."""

    key = None

    def once(self, step: str, work: Callable[[], dict | None]) -> dict:
        return work() or {}
