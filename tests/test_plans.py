"""Plans of the registered queries: what they may and may not contain."""

import os
import re
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))
from compare import load_entry  # noqa: E402

entry = load_entry()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", entry.REGISTERED, ids=lambda q: q.name)
def test_no_pairing_joins_and_no_row_at_a_time_python(spark, sf_dir, query):
    text = plan(query.run(spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text


def read_schemas(text):
    return re.findall(r"ReadSchema: struct<([^\n]*)>", text)


def test_only_needed_columns_are_read(spark, sf_dir):
    q = entry.queries()
    long = read_schemas(plan(q["classify_all_above_threshold"](spark, sf_dir)))
    assert all("l_extendedprice" not in s and "l_shipdate" not in s for s in long)
    files = read_schemas(plan(q["manifest_audio_files"](spark, sf_dir)))
    assert files == ["p_partkey:bigint,p_name:string,p_brand:string,p_size:int"]
    held = read_schemas(plan(q["incremental_new_windows"](spark, sf_dir)))
    assert "l_orderkey:bigint,l_suppkey:bigint,l_linenumber:int" in held


def test_threshold_is_checked_before_the_shuffle(spark, sf_dir):
    text = plan(entry.queries()["classify_topn_long"](spark, sf_dir))
    assert text.count("WindowGroupLimit") == 2
    below_exchange = text[text.index("Exchange hashpartitioning(window_id"):]
    assert "WindowGroupLimit" in below_exchange and ">= 0.0" in below_exchange


def test_publishing_shuffles_twice_and_samples_no_wide_column(spark, sf_dir):
    """The distinct and the ranges; nothing is sampled by Spark's own range partitioning."""
    text = plan(entry.queries()["dedupe_sorted"](spark, sf_dir))
    assert "rangepartitioning" not in text
    assert text.count("Exchange ") == 2 and "hashpartitioning(dest" in text


def test_framing_doesnt_shuffle(spark, sf_dir):
    for name in ("frame_windows", "frame_shards", "recognizer_scores_above", "channels_expanded"):
        assert "Exchange" not in plan(entry.queries()[name](spark, sf_dir)), name


def test_skewed_recording_is_split(spark):
    """A recording with a third of all windows, joined to recordings too large to broadcast."""
    from pyspark.sql import functions as F

    from dawnchorus.operators import store

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1MB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1MB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        windows = spark.range(0, 300_000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("recording_id"),
            F.sha2(F.col("id").cast("string"), 512).alias("payload"),
        )
        recordings = spark.range(300_000).select(
            F.col("id").alias("recording_id"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("source")
        )
        joined = store.windows_by_source(windows, recordings)
        joined.collect()
        text = plan(joined)
        assert "skew=true" in text
        assert joined.count() == 300_000
    finally:
        for k in settings:
            spark.conf.unset(k)
