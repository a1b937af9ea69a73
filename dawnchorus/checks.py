"""Checks that must stop a job before anything is written.

An error expression inside a lazy plan may be pruned away or surface after
half the output exists, so integrity rules run as explicit actions. Each one
brings at most ``SHOWN`` rows to the driver, whatever the size of the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from dawnchorus.sizing import write_scratch

SHOWN = 10


def require_none(bad: DataFrame, message: str, error: type[Exception] = ValueError) -> None:
    """Raise if ``bad`` has any row, quoting the first few; a longer list is written to a folder the error names."""
    rows = bad.limit(SHOWN + 1).collect()
    if rows:
        shown = [r[0] if len(r) == 1 else r.asDict() for r in rows[:SHOWN]]
        more = f" and more, all in {write_scratch(bad)}" if len(rows) > SHOWN else ""
        raise error(f"{message}: {shown}{more}")
