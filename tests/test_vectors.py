import numpy as np
import pytest
from pyspark.sql import functions as F

from dawnchorus.functions import vectors as v


def frame(spark, rows, schema="id int, e array<float>"):
    return spark.createDataFrame(rows, schema)


def test_known_packed_value(spark):
    got = v.pack(frame(spark, [(1, [1.234, 2.345, 3.456])]), "e").first()["embeddings"]
    assert got == "tvOdP3sUFkAbL11A"


def test_round_trip_with_empty_null_and_special_values(spark):
    rows = [(1, []), (2, None), (3, [float("nan"), float("inf"), -0.0, 1e-40]), (4, [5.5])]
    back = v.unpack(v.pack(frame(spark, rows), "e"), "embeddings", "back").orderBy("id").collect()
    assert back[0]["back"] == [] and back[1]["back"] is None and back[3]["back"] == [5.5]
    a, b = np.array(back[2]["e"], "<f4"), np.array(back[2]["back"], "<f4")
    assert a.tobytes() == b.tobytes()


def test_wrong_type_is_refused(spark):
    with pytest.raises(TypeError):
        v.pack(spark.createDataFrame([(1, [1.0])], "id int, e array<double>"), "e")
    with pytest.raises(TypeError):
        v.pack(spark.createDataFrame([(1, "x")], "id int, e string"), "e")


def test_column_names():
    assert v.feature_names(3) == ["f0000", "f0001", "f0002"]
    assert v.feature_names(1281)[-1] == "f1280"


def test_wide_and_back(spark):
    rng = np.random.default_rng(7)
    rows = [(i, float(5 * i), rng.normal(size=10).astype("float32").tolist()) for i in range(5)]
    df = frame(spark, rows, "channel int, offset double, e array<float>")
    wide = v.widen(df, "e")
    assert wide.columns == ["channel", "offset", *v.feature_names(10)]
    packed = v.narrow(wide)
    assert packed.columns == ["channel", "offset", "embeddings"]
    again = v.unpack_wide(packed)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, wide.collect()))


def test_metadata_may_stand_anywhere(spark):
    df = spark.createDataFrame([(1.0, 7, 2.0)], "f0000 float, channel int, f0001 float")
    got = v.unpack(v.narrow(df, ("channel",)), "embeddings").first()
    assert got["channel"] == 7 and got["embedding"] == [1.0, 2.0]


def test_missing_columns(spark):
    df = frame(spark, [(1, [1.0])])
    with pytest.raises(ValueError, match="metadata"):
        v.narrow(df, ("nope",))
    with pytest.raises(ValueError, match="packed column"):
        v.unpack_wide(df, "nope")


def test_ragged_vectors_fail(spark):
    df = frame(spark, [(1, [1.0, 2.0]), (2, [1.0])])
    with pytest.raises(ValueError, match="different lengths"):
        v.uniform_width(df, "e")
    with pytest.raises(Exception, match="another length"):
        v.widen(df, "e").collect()


def test_wide_vectors_of_model_size(spark):
    df = spark.range(20).select(
        F.col("id").cast("int").alias("channel"),
        F.transform(F.sequence(F.lit(0), F.lit(1535)), lambda i: (i + F.col("id")).cast("float")).alias("e"),
    )
    wide = v.widen(df, "e", 1536)
    row = wide.where("channel = 3").first()
    assert len(wide.columns) == 1537 and row["f1535"] == 1538.0
