"""Run registered queries and their SQL side by side and compare whole results.

    python tools/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import importlib.util
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def load_entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), na_position="last", kind="stable").reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    got, want = canonical(got), canonical(want)
    for c in got.columns:
        a, b = got[c], want[c]
        if str(a.dtype).lower() != str(b.dtype).lower():
            return f"type of {c}: {a.dtype} / {b.dtype}"
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            i = (~same).idxmax()
            return f"{(~same).sum()} values of {c}, first {a[i]!r} / {b[i]!r}"
    return None


def main() -> int:
    from dawnchorus.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    entry = load_entry()
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    wanted = sys.argv[2:] or list(entry.queries())
    sql = entry.oracle_sql()
    bad = 0
    for name in wanted:
        began = time.time()
        try:
            got = entry.queries()[name](spark, sf_dir).toPandas()
            took = time.time() - began
            why = difference(got, con.execute(sql[name]).df()) if name in sql else "no SQL"
        except Exception as e:  # noqa: BLE001
            took, why, got = time.time() - began, f"{type(e).__name__}: {str(e)[:600]}", []
        bad += why is not None and why != "no SQL"
        print(f"{'ok ' if why is None else 'BAD'} {name:34s} {len(got):8d} rows {took:6.2f} s  {why or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
