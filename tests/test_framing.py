import pytest
from pyspark.sql import functions as F

from dawnchorus.operators import framing as f
from dawnchorus.functions.text import window_key
from dawnchorus.operators.inference import infer


def shards(spark, *durations, **kw):
    df = spark.createDataFrame([(i, float(d)) for i, d in enumerate(durations)], "recording_id long, duration_s double")
    return f.shard_recordings(df, **kw)


def test_shards(spark):
    got = shards(spark, 0, 0.5, 1, 60, 60.5, 61, 150).orderBy("recording_id", "shard_idx").collect()
    assert [(r["recording_id"], r["shard_idx"], r["shard_offset_s"], r["shard_len_s"]) for r in got] == [
        (2, 0, 0.0, 1.0), (3, 0, 0.0, 60.0), (4, 0, 0.0, 60.0), (5, 0, 0.0, 60.0), (5, 1, 60.0, 1.0),
        (6, 0, 0.0, 60.0), (6, 1, 60.0, 60.0), (6, 2, 120.0, 30.0),
    ]


def test_very_long_recording_in_blocks(spark):
    got = shards(spark, 60.0 * 10_000 + 30).agg(F.count("*"), F.max("shard_idx"), F.countDistinct("shard_idx"), F.sum("shard_len_s")).first()
    assert tuple(got) == (10_001, 10_000, 10_001, 600_030.0)


def test_hundred_seconds_give_twenty_windows(spark):
    w = f.window_shards(shards(spark, 100))
    got = w.orderBy("window_idx").collect()
    assert len(got) == 20
    assert [r["offset_s"] for r in got] == [5.0 * i for i in range(20)]
    assert [r["window_idx"] for r in got] == list(range(20))
    assert all(r["end_s"] - r["offset_s"] == 5.0 for r in got)


@pytest.mark.parametrize("length, drop, pad", [(1, 1, 1), (4.9, 1, 1), (5, 1, 1), (5.1, 1, 2), (59, 11, 12), (60, 12, 12)])
def test_partial_windows(spark, length, drop, pad):
    assert f.window_shards(shards(spark, length)).count() == drop
    assert f.window_shards(shards(spark, length), partial="pad").count() == pad
    with pytest.raises(ValueError):
        f.window_shards(shards(spark, length), partial="keep")


def test_overlapping_windows_stay_inside_their_shard(spark):
    w = f.window_shards(shards(spark, 120), window_s=5.0, hop_s=2.5)
    assert w.where("end_s > shard_offset_s + shard_len_s").isEmpty()
    assert w.count() == 2 * 23 and w.select("window_idx").distinct().count() == 46


def test_spread_keeps_rows(spark):
    s = shards(spark, 600, 30)
    assert f.spread_shards(s, 4).exceptAll(s).isEmpty()


def test_long_recording_is_spread_over_fixed_tasks(spark):
    s = f.spread_shards(shards(spark, 60.0 * 900, *[60.0] * 30), 6)
    s = s.withColumn("task", F.spark_partition_id())
    assert s.select("task").distinct().count() == 6
    assert s.where("recording_id = 0").select("task").distinct().count() >= 5


def test_keys(spark):
    df = spark.createDataFrame([("a/b.wav", 5.0), ("c.wav", 12345.0)], "s string, o double")
    assert [r[0] for r in df.select(window_key(F.col("s"), F.col("o"))).collect()] == ["a/b.wav_5.0", "c.wav_12345.0"]


def model_loader(kind):
    def load():
        import numpy as np

        def model(samples):
            if samples[0] < 0:
                return None
            emb = np.stack([samples.reshape(2, 2), samples.reshape(2, 2) * 10], axis=1)
            flat = {"other": emb[:, 0], "label": emb.sum(axis=1)}
            return emb, {"flat": flat, "deep": {"label": emb}, "first": {"other": emb[:, 0]}, "none": None}[kind]

        return model

    return load


@pytest.mark.parametrize(
    "kind, logits",
    [("flat", [[11.0, 22.0], [11.0, 22.0], [33.0, 44.0], [33.0, 44.0]]),
     ("deep", [[1.0, 2.0], [10.0, 20.0], [3.0, 4.0], [30.0, 40.0]]),
     ("first", [[1.0, 2.0], [1.0, 2.0], [3.0, 4.0], [3.0, 4.0]]),
     ("none", [None] * 4)],
)
def test_model_batches(spark, kind, logits):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0]), (2, [-1.0, 0.0, 0.0, 0.0]), (3, None)], "id long, samples array<float>")
    got = infer(df, model_loader(kind), "samples", ["id"], with_logits=True).orderBy("t", "channel").collect()
    assert [(r["id"], r["t"], r["channel"]) for r in got] == [(1, 0, 0), (1, 0, 1), (1, 1, 0), (1, 1, 1)]
    assert [r["embedding"] for r in got] == [[1.0, 2.0], [10.0, 20.0], [3.0, 4.0], [30.0, 40.0]]
    assert [r["logits"] for r in got] == logits
    assert "logits" not in infer(df, model_loader(kind), "samples", ["id"]).columns


def test_batches_without_any_result(spark):
    df = spark.createDataFrame([(2, [-1.0, 0.0, 0.0, 0.0]), (3, None)], "id long, samples array<float>")
    assert infer(df, model_loader("flat"), "samples", ["id"], with_logits=True).count() == 0


def test_key_names_need_not_be_identifiers(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0])], "`my id` long, samples array<float>")
    got = infer(df, model_loader("deep"), "samples", ["my id"]).collect()
    assert [r["my id"] for r in got] == [1] * 4


def block_model(folder, dim=2, hop=4):
    """Frames of ``hop`` samples of a whole block; every call leaves a mark."""

    def load():
        import os
        import uuid

        import numpy as np

        def model(samples):
            open(os.path.join(folder, f"{samples.shape[0]}x{samples.shape[1]}-{uuid.uuid4().hex}"), "w").close()
            n, t = samples.shape[0], samples.shape[1] // hop
            cells = samples[:, : t * hop].reshape(n, t, 1, hop)
            return cells[..., :dim], {"label": cells[:, :, 0].sum(axis=2, keepdims=True)}

        return model

    return load


@pytest.mark.parametrize("shards,size", [(70, 32), (64, 32), (3, 32), (5, 1)])
def test_one_call_per_block_of_shards(spark, tmp_path, shards, size):
    rows = [(i, [float(i)] * (4 * (1 + i % 3) + i % 2)) for i in range(shards)] + [(-1, None)]
    df = spark.createDataFrame(rows, "id int, samples array<float>").coalesce(1)
    got = infer(df, block_model(str(tmp_path)), "samples", ["id"], True, batch_size=size, frames=lambda n: n // 4).collect()
    calls = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert len(calls) == -(-shards // size) and {c.split("x")[0] for c in calls} == {str(size)}
    want = {(i, t): (0, [float(i)] * 2, [4.0 * i]) for i in range(shards) for t in range(1 + i % 3)}
    assert {(r["id"], r["t"]): (r["channel"], r["embedding"], r["logits"]) for r in got} == want and len(got) == len(want)


def test_blocks_of_a_given_length(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0] * 8)], "id int, samples array<float>")
    got = infer(df, block_model(str(tmp_path)), "samples", ["id"], batch_size=4, length=20).collect()
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["4x20"]
    assert [r["embedding"] for r in got] == [[1.0, 1.0]] * 2 + [[0.0, 0.0]] * 3  # without frames, all are given
    with pytest.raises(Exception, match="more than the block"):
        infer(df, block_model(str(tmp_path)), "samples", ["id"], batch_size=4, length=4).collect()
    with pytest.raises(ValueError):
        infer(df, block_model(str(tmp_path)), "samples", ["id"], batch_size=0)
