"""Files at their destinations: replaced whole, recovered after a lost driver, facts in the footers."""

import json
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from dawnchorus.operators import publish as p
from dawnchorus.sinks import tree as t

SCHEMA = "source string, channel int, offset double, label string, score double"


def rows(spark, n=3000):
    base = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot.parquet").otherwise(F.concat(F.lit("site/"), (F.col("id") % 5).cast("string"), F.lit(".parquet"))).alias("dest"),
        F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("source"),
        F.lit(0).alias("channel"),
        ((n - F.col("id")) * 5.0).alias("offset"),
        F.lit("L").alias("label"),
        (F.col("id") * 0.5).alias("score"),
    )
    return base.unionByName(base).repartition(5)


def files(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names if not f.startswith("."))


@pytest.mark.parametrize("partitions", [1, 6])
def test_files_stand_at_their_paths(spark, tmp_path, partitions):
    root = str(tmp_path / "out")
    df = rows(spark)
    p.publish(df, root, partitions=partitions, tree=True, provenance={"config": '{"a": 1}'})
    found = files(root)
    if partitions == 1:
        assert found == ["hot.parquet", *[f"site/{k}.parquet" for k in range(5)]]
    assert not os.path.exists(f"{root}/{t.STAGING}/x") and os.listdir(f"{root}/{t.STAGING}") == []
    total = 0
    for dest in ["hot.parquet", *[f"site/{k}.parquet" for k in range(5)]]:
        got = t.read_destination(spark, root, dest)
        want = df.where(F.col("dest") == dest).drop("dest").distinct()
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
        total += got.count()
    assert total == 3000
    keys = []
    parts = [f for f in found if f.startswith("hot.parquet")]
    assert len(parts) > 1 or partitions == 1
    for f in parts:
        held = pq.read_table(f"{root}/{f}")
        assert held.schema.metadata[b"config"] == b'{"a": 1}'
        keys += list(zip(held["source"].to_pylist(), held["offset"].to_pylist(), strict=True))
    assert keys == sorted(keys)


def test_only_named_destinations_are_replaced(spark, tmp_path):
    root = str(tmp_path / "out")
    df = rows(spark, 600)
    p.publish(df, root, partitions=4, tree=True)
    again = df.where("dest = 'hot.parquet'").withColumn("label", F.lit("new"))
    p.publish(again, root, partitions=1, tree=True)  # a folder of parts becomes a file
    assert os.path.isfile(f"{root}/hot.parquet")
    assert {r["label"] for r in t.read_destination(spark, root, "hot.parquet").collect()} == {"new"}
    assert t.read_destination(spark, root, "site/1.parquet").where("label = 'L'").count() == 80


def test_failed_tasks_leave_the_former_files(spark, tmp_path):
    root = str(tmp_path / "out")
    df = rows(spark, 300)
    p.publish(df, root, tree=True, partitions=2)
    before = files(root)
    broken = df.withColumn("label", F.when(F.col("score") > 100, F.raise_error(F.lit("boom"))).otherwise("bad"))
    with pytest.raises(Exception, match="boom"):
        p.publish(broken, root, tree=True, partitions=2, dedupe=False)
    assert files(root) == before and t.read_destination(spark, root, "hot.parquet").where("label = 'bad'").isEmpty()


def test_a_commit_that_stopped_half_way_is_finished(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "out")
    os.makedirs(f"{root}/a")
    writer = t.TreeWriter(root, "parquet", {})
    staged = f"{root}/{t.STAGING}/{writer.job}/x"
    os.makedirs(staged)
    plan = {}
    for k, dest in enumerate(["a/1.parquet", "a/2.parquet", "a/2.parquet"]):
        spark.range(k + 1).toPandas().to_parquet(f"{staged}/{k}")
        plan.setdefault(dest, []).append(f"{staged}/{k}")
    with open(f"{root}/{t.STAGING}/{writer.job}/moves.json", "w") as f:
        json.dump(plan, f)
    os.makedirs(f"{root}/a/2.parquet")
    os.rename(f"{staged}/1", f"{root}/a/2.parquet/part-00000.parquet")  # where the driver was lost
    os.makedirs(f"{root}/{t.STAGING}/other/x")  # a job that never came to its commit
    assert t.recover(root) == [writer.job]
    assert t.read_destination(spark, root, "a/1.parquet").count() == 1
    assert t.read_destination(spark, root, "a/2.parquet").count() == 5
    assert os.listdir(f"{root}/{t.STAGING}") == [] and t.recover(root) == []


@pytest.mark.parametrize("dest", ["/abs.parquet", "../up.parquet", "a/../../b", "_staging/x", ""])
def test_unsafe_destinations(spark, tmp_path, dest):
    df = spark.createDataFrame([(dest, "s", 0, 0.0)], "dest string, source string, channel int, offset double")
    with pytest.raises(Exception, match="unsafe destination"):
        t.write_tree(df, str(tmp_path / "out"))


def test_csv_keeps_nulls_and_empty_texts(spark, tmp_path):
    root = str(tmp_path / "csv")
    df = spark.createDataFrame(
        [("d/x.csv", "007", 0, 5.0, "NA", 0.5), ("d/x.csv", "a,b", 0, 0.0, "", None), ("d/x.csv", 'q"', 1, 1.5, None, 0.25)],
        "dest string, source string, channel int, offset double, label string, score double",
    )
    p.publish(df, root, "csv", {"runner": "1"}, tree=True)
    got = {r["source"]: tuple(r)[1:] for r in t.read_destination(spark, root, "d/x.csv", "csv", SCHEMA).collect()}
    assert got == {"007": (0, 5.0, "NA", 0.5), "a,b": (0, 0.0, "", None), 'q"': (1, 1.5, None, 0.25)}
