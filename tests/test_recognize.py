import base64
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from dawnchorus.operators import recognize as r
from dawnchorus.sources.tables import recognizer_definitions


def text(values):
    return base64.b64encode(struct.pack(f"<{len(values)}f", *values)).decode()


def definition(name, classes, beta, bias):
    return {
        "name": name,
        "classes": classes,
        "beta": text(beta),
        "beta_bias": text(bias),
        "notes": "n",
        "model_config": {
            "model_key": "m",
            "embedding_dim": len(beta) // len(classes),
            "model_config": {"window_size_s": 5.0, "hop_size_s": 5.0, "sample_rate": 32000},
        },
    }


@pytest.fixture()
def windows(spark):
    rows = [(i, [float(i), 1.0, -2.0]) for i in range(4)]
    return spark.createDataFrame(rows, "w int, embedding array<float>")


def test_files_of_every_shape(spark, tmp_path):
    one = definition("koala", ["Koala"], [1.0, 2.0, 3.0], [0.5])
    two = definition("owls", ["Boobook", "Barking"], [1, 10, 2, 20, 3, 30], [0.25, 0.75])
    shapes = {"object": one, "list": [one, two], "wrapped": {"recognizers": [two]}}
    paths = []
    for name, body in shapes.items():
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(body, indent=1))
        paths.append(str(path))
    got = {}
    for path in paths:
        rows = recognizer_definitions(spark, path).collect()
        got[path.rsplit("/", 1)[1]] = {(x["classifier_name"], x["label"]): x for x in rows}
    assert set(got["object.json"]) == {("koala", "Koala")}
    assert set(got["list.json"]) == {("koala", "Koala"), ("owls", "Boobook"), ("owls", "Barking")}
    barking = got["wrapped.json"][("owls", "Barking")]
    assert barking["beta"] == [10.0, 20.0, 30.0] and barking["bias"] == 0.75 and barking["embedding_dim"] == 3
    assert recognizer_definitions(spark, paths).count() == 6


def test_scores_of_several_recognizers(spark, windows):
    recs = spark.createDataFrame(
        [("a", 0, "A", [1.0, 2.0, 3.0], 0.5), ("b", 0, "B0", [0.0, 0.0, 1.0], 0.0), ("b", 1, "B1", [1.0, 0.0, 0.0], 1.0)],
        "classifier_name string, class_idx int, label string, beta array<float>, bias float",
    )
    got = {(x["w"], x["label"]): x["score"] for x in r.score(windows, recs, ["w"]).collect()}
    want = {}
    for i in range(4):
        want |= {(i, "A"): i + 2 - 6 + 0.5, (i, "B0"): -2.0, (i, "B1"): i + 1.0}
    assert got == want
    blocks = {(x["w"], x["label"]): x["score"] for x in r.score(windows, recs, ["w"], block_bytes=60).collect()}
    assert blocks == want
    high = r.score(windows, recs, ["w"], min_score=2.0).collect()
    assert {(x["w"], x["label"]) for x in high} == {k for k, s in want.items() if s >= 2.0}
    sig = r.score(windows, recs, ["w"], activation=lambda s: 1 / (1 + np.exp(-s))).where("label = 'B0'").first()
    assert sig["score"] == pytest.approx(1 / (1 + np.exp(2.0)))


def test_windows_without_vectors_give_no_row(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, None)], "w int, embedding array<float>")
    recs = spark.createDataFrame([("a", 0, "A", [2.0], 0.0)], "classifier_name string, class_idx int, label string, beta array<float>, bias float")
    assert [x["w"] for x in r.score(df, recs, ["w"]).collect()] == [1]
    assert r.score(df, recs.where("bias > 1"), ["w"]).count() == 0


def test_misfits_are_listed_together(spark, windows):
    recs = spark.createDataFrame(
        [("a", 0, "A", [1.0], 0.0), ("b", 0, "B", [1.0, 2.0], 0.0), ("c", 0, "C", [1.0, 2.0, 3.0], 0.0)],
        "classifier_name string, class_idx int, label string, beta array<float>, bias float",
    )
    with pytest.raises(RuntimeError, match="a: recognizer has dimension 1.*; b: recognizer has dimension 2"):
        r.require_compatible(windows, recs)
    r.require_compatible(windows, recs.where("classifier_name = 'c'"))
    with pytest.raises(Exception, match="recognizer has dimension 2"):
        r.score(windows, recs.where("classifier_name = 'b'"), ["w"]).collect()


def test_scoring_pairs_no_rows(spark, windows):
    recs = spark.createDataFrame([("a", 0, "A", [1.0, 2.0, 3.0], 0.5)], "classifier_name string, class_idx int, label string, beta array<float>, bias float")
    plan = r.score(windows, recs, ["w"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Cartesian" not in plan


def test_repeated_definition(spark):
    recs = spark.createDataFrame([("a", 0), ("a", 0)], "classifier_name string, class_idx int")
    with pytest.raises(ValueError, match="more than once"):
        r.require_unique_names(recs)


def test_model_sized_weights(spark):
    rng = np.random.default_rng(3)
    beta, emb = rng.normal(size=(40, 1280)).astype("float32"), rng.normal(size=(50, 1280)).astype("float32")
    recs = spark.createDataFrame(
        [("m", i, f"c{i}", beta[i].tolist(), 0.1) for i in range(40)],
        "classifier_name string, class_idx int, label string, beta array<float>, bias float",
    )
    df = spark.createDataFrame([(i, emb[i].tolist()) for i in range(50)], "w int, embedding array<float>")
    got = r.score(df, recs, ["w"]).groupBy().pivot("label").agg(F.sum("score")).first().asDict()
    want = (emb.astype("float64") @ beta.T.astype("float64") + np.float32(0.1)).sum(axis=0)
    for i in range(40):
        assert got[f"c{i}"] == pytest.approx(want[i], rel=1e-9)


def test_a_task_opens_one_tile_at_a_time():
    """Tiles are opened once per block of windows and never two at once."""
    import contextlib

    import pyarrow as pa

    opened = []

    class Counted:
        now = 0

        def __init__(self, at):
            self.at = at

        @contextlib.contextmanager
        def opened(self, keep=False):
            assert not keep and Counted.now == 0
            Counted.now += 1
            opened.append(self.at)
            yield np.eye(2)[:, [self.at]], np.zeros(1), ["r"], [f"c{self.at}"]
            Counted.now -= 1

    def batch(k, n):
        values = pa.array([[float(k), float(i)] for i in range(n)], pa.list_(pa.float32()))
        return pa.RecordBatch.from_arrays([pa.array([k] * n), values], ["w", "embedding"])

    run = r._scorer([Counted(0), Counted(1)], 2, ["w"], "embedding", None, None, block_bytes=100)
    out = list(run(iter([batch(k, 8) for k in range(5)])))
    assert sum(b.num_rows for b in out) == 5 * 8 * 2
    assert opened == [0, 1, 0, 1, 0, 1]  # blocks of 16 windows: two batches, two, one
    assert {(b["w"][0].as_py(), b["label"][0].as_py()): b["score"][0].as_py() for b in out}[(3, "c0")] == 3.0


def test_many_tiles_equal_one(spark):
    rng = np.random.default_rng(5)
    beta, emb = rng.normal(size=(60, 16)), rng.normal(size=(300, 16))
    recs = spark.createDataFrame(
        [(f"m{i % 7}", i, f"c{i}", beta[i].tolist(), 0.1) for i in range(60)],
        "classifier_name string, class_idx int, label string, beta array<float>, bias float",
    )
    df = spark.createDataFrame([(i, emb[i].tolist()) for i in range(300)], "w int, embedding array<float>").repartition(3)
    one = {(x["w"], x["label"]): x["score"] for x in r.score(df, recs, ["w"]).collect()}
    many = {(x["w"], x["label"]): x["score"] for x in r.score(df, recs, ["w"], block_bytes=600).collect()}
    assert len(list(r.weight_blocks(recs, 600))) > 10 and len(one) == 18_000
    assert many == pytest.approx(one, rel=1e-12)
