import glob
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from dawnchorus.operators import publish as p
from dawnchorus.schemas import RESULTS


def rows(spark, n=4000, hot="flat.parquet"):
    """A third of the rows in one destination, every row twice."""
    base = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, hot).otherwise(F.concat(F.lit("site/"), (F.col("id") % 5).cast("string"))).alias("dest"),
        F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("source"),
        F.lit(0).alias("channel"),
        ((n - F.col("id")) * 5.0).alias("offset"),
        F.lit("L").alias("label"),
        (F.col("id") * 0.5).alias("score"),
    )
    return base.unionByName(base).repartition(8)


def test_rows_are_distinct_sorted_and_whole(spark, tmp_path):
    root = str(tmp_path / "out")
    df = rows(spark)
    p.publish(df, root)
    back = p.read_published(spark, root)
    assert back.count() == 4000
    assert df.distinct().exceptAll(back.select(df.columns)).isEmpty()
    folders = sorted(d for d in os.listdir(root) if d.startswith("dest="))
    assert len(folders) == 6
    for folder in folders:
        keys = []
        for file in sorted(glob.glob(f"{root}/{folder}/*.parquet")):
            t = pq.read_table(file).to_pydict()
            keys += list(zip(t["source"], t["offset"]))
        assert keys == sorted(keys)


def test_hot_destination_is_split(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        df = p.arrange(rows(spark), partitions=6)
        parts = df.where("dest = 'flat.parquet'").select(F.spark_partition_id().alias("k")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts >= 2


def test_other_destinations_stay(spark, tmp_path):
    root = str(tmp_path / "out")
    first = rows(spark, 300)
    p.publish(first, root)
    p.publish(first.where("dest = 'site/1'").withColumn("label", F.lit("new")), root)
    back = p.read_published(spark, root)
    assert back.where("dest = 'site/1' AND label <> 'new'").isEmpty()
    assert back.count() == 300


def test_failed_job_keeps_the_former_output(spark, tmp_path):
    root = str(tmp_path / "out")
    df = rows(spark, 300)
    p.publish(df, root)
    broken = df.withColumn("score", F.when(F.col("score") > 100, F.raise_error(F.lit("boom")).cast("double")).otherwise(-1.0))
    with pytest.raises(Exception, match="boom"):
        p.publish(broken, root)
    assert p.read_published(spark, root).where("score = -1").isEmpty()
    assert p.read_published(spark, root).count() == 300


def test_key_check_spares_the_wide_distinct(spark):
    df = rows(spark, 100)
    unique = df.dropDuplicates()
    key = ("dest", "source", "channel", "offset")
    assert p.deduplicate(unique, key) is unique
    assert p.deduplicate(df, key).count() == 100
    # same key, different vectors: both rows stay
    two = spark.createDataFrame([("d", "s", 0, 0.0, [1.0]), ("d", "s", 0, 0.0, [2.0]), ("d", "s", 0, 0.0, [2.0])],
                                "dest string, source string, channel int, offset double, e array<float>")
    assert p.deduplicate(two, key).count() == 2
    nulls = spark.createDataFrame([(None, 1, 2.0)] * 3 + [("a", None, 2.0)] * 2 + [("b", 1, 1.0)],
                                  "dest string, channel int, v double")
    assert p.deduplicate(nulls, ("dest", "channel")).count() == 3


def test_of_many_repeated_keys_only_copies_travel(spark, monkeypatch):
    """600,000 rows with a repeated key among 1,400,000: the distinct sees them and about a hundredth of the others."""
    monkeypatch.setattr(p, "BROADCAST_ROWS", 10)
    once = spark.range(800_000).select((F.col("id") * 5.0).alias("offset"), F.concat(F.lit("s"), F.col("id") % 97).alias("source"), F.lit("v").alias("v"))
    twice = once.where("offset < 1500000").withColumn("v", F.when(F.col("offset") % 10 == 0, "w").otherwise(F.col("v")))
    df = once.unionByName(twice)
    got = p.deduplicate(df, ("source", "offset"))
    assert got.count() == 800_000 + 150_000 and got.distinct().count() == 950_000
    again = p.repeated(df, ("source", "offset"))
    n = again.count()
    assert n == 300_000
    copy = p.maybe_among(df, again, ("source", "offset"), n)
    assert df.where(copy).where("offset < 1500000").count() == 600_000
    assert df.where(copy).where("offset >= 1500000").count() < 0.02 * 500_000
    text = got._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


def test_too_many_repeated_keys_take_the_full_distinct(spark, monkeypatch):
    monkeypatch.setattr(p, "BROADCAST_ROWS", 10)
    df = rows(spark, 100).withColumn("source", F.when(F.col("offset") > 250, F.col("source")))
    key = ("dest", "source", "channel", "offset")
    assert p.deduplicate(df, key).count() == 100
    monkeypatch.setattr(p, "FILTER_BYTES", 10)
    assert p.deduplicate(df, key).count() == 100


def test_csv_nulls_text_and_types(spark, tmp_path):
    root = str(tmp_path / "csv")
    df = spark.createDataFrame(
        [("d", "007", 0, 5.0, "NA", 0.5, "12"), ("d", "008", 0, 0.0, "", 0.25, None)],
        "dest string, source string, channel int, offset double, label string, score double, audio_recording_id string",
    )
    p.publish(df, root, "csv", {"runner": "1"})
    text = "".join(open(f).read() for f in sorted(glob.glob(f"{root}/dest=d/*.csv")))
    assert text.splitlines() == [
        "source,channel,offset,label,score,audio_recording_id", "007,0,5.0,NA,0.5,12", '008,0,0.0,"",0.25,'
    ]
    back = p.read_published(spark, root, "csv", RESULTS + ", audio_recording_id string")
    got = {r["source"]: (r["label"], r["audio_recording_id"]) for r in back.collect()}
    assert got == {"007": ("NA", "12"), "008": ("", None)}


def test_provenance_in_the_footer(spark, tmp_path):
    root = str(tmp_path / "out")
    p.publish(rows(spark, 50), root, provenance={"version": "1.2", "config": '{"embed": true}'})
    back = p.read_published(spark, root)
    assert p.read_provenance(back) == {"version": "1.2", "config": '{"embed": true}'}
    file = glob.glob(f"{root}/dest=*/*.parquet")[0]
    assert b"provenance" in pq.read_metadata(file).metadata[b"org.apache.spark.sql.parquet.row.metadata"]
    assert pq.ParquetFile(file).metadata.row_group(0).column(0).compression == "SNAPPY"


def test_unknown_file_type(spark):
    with pytest.raises(ValueError, match="unsupported"):
        p.publish(rows(spark, 3), "/tmp/x", "json")


def test_ranges_are_even_and_in_order(spark):
    """A third of the rows in one destination, many of them in one source: all ranges of like size, in key order."""
    df = rows(spark, 20_000).distinct()
    got = p.arrange(df, partitions=8).withColumn("part", F.spark_partition_id())
    sizes = [r["count"] for r in got.groupBy("part").count().orderBy("part").collect()]
    assert len(sizes) == 8 and sum(sizes) == 20_000 and max(sizes) < 2 * min(sizes)
    listed = [(r["part"], r["dest"], r["source"], r["offset"]) for r in got.collect()]
    assert [x[1:] for x in sorted(listed)] == sorted(x[1:] for x in listed)


def test_range_keys_may_be_null(spark):
    df = spark.createDataFrame(
        [(None if i % 5 == 0 else f"d{i % 3}", None if i % 7 == 0 else f"s{i % 11}", i * 0.5) for i in range(500)],
        "dest string, source string, offset double",
    )
    got = p.arrange(df, partitions=5).withColumn("part", F.spark_partition_id()).collect()
    order = [(r["part"], (r["dest"] is not None, r["dest"] or ""), (r["source"] is not None, r["source"] or ""), r["offset"]) for r in got]
    assert len(order) == 500 and [x[1:] for x in sorted(order)] == sorted(x[1:] for x in order)


def test_vectors_are_computed_once(spark, tmp_path):
    """The ranges come from the keys: an export evaluates each vector a single time (and those of a few rows for their size)."""
    mark = spark.sparkContext.accumulator(0)

    def vectors(batches):
        import pyarrow as pa

        for b in batches:
            mark.add(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[1.0] * 8] * b.num_rows, pa.list_(pa.float32()))], ["id", "embedding"])

    wide = spark.range(2000).mapInArrow(vectors, "id long, embedding array<float>")
    keyed = spark.range(2000).select("id", F.lit("d").alias("dest"), F.concat(F.lit("s"), F.col("id") % 9).alias("source"), (F.col("id") * 5.0).alias("offset"))
    df = keyed.join(wide, "id").drop("id")
    out = p.arrange(df, partitions=4, like=keyed)
    assert mark.value == 0
    out.write.mode("overwrite").parquet(str(tmp_path / "o"))
    assert mark.value == 2000
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2000
