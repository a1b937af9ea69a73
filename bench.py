"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Each
query is evaluated in full into a sink that discards rows; the best of
BENCH_RUNS (default 2) counts, so that the first one pays for the warm-up.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "classify_topn",
    "classify_topn_long",
    "classify_species_filter_long",
    "classify_export",
    "recognizer_scores",
    "recognizer_export",
    "embeddings_serialized",
    "embeddings_columns",
    "frame_windows",
    "sourcemap_render",
    "route_counts",
    "dedupe_sorted",
    "published_parquet",
    "published_csv",
    "taxonomy_translate_code_first",
    "taxonomy_translate_name_first",
    "labels_harmonized",
    "incremental_new_windows",
    "windows_by_source",
    "window_store",
]


def main() -> None:
    from dawnchorus.session import local_session

    import importlib.util

    here = os.path.dirname(os.path.abspath(__file__))
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(here, "__spark_entry__.py"))
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries = entry.queries()
    seconds = {}
    for name in HEADLINE:
        best = None
        for _ in range(runs):
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
