"""No cap, prefix or guessed type changes a result."""

import base64

import numpy as np
import pytest
from pyspark.sql import functions as F

from dawnchorus.functions.vectors import unpack
from dawnchorus.operators import classify, recognize
from dawnchorus.operators.routing import check_template
from dawnchorus.operators.store import WindowStore
from dawnchorus.sources.tables import decode_definitions


def packed(values):
    return base64.b64encode(np.asarray(values, dtype="<f4").tobytes()).decode()


def test_long_species_lists_filter(spark):
    classes = spark.range(20_015).select(F.col("id").cast("int").alias("class_idx"), F.concat(F.lit("c"), "id").alias("label"))
    species = classes.where("class_idx < 20010").select(F.col("label").alias("raw"))
    windows = spark.range(1).select("id", F.transform(F.sequence(F.lit(0), F.lit(20_014)), lambda i: i.cast("float")).alias("logits"))
    allowed = classify.allowed_classes(classes, species)
    found = classify.top_classes(windows, "logits", -1000.0, 3, allowed)
    assert sorted(r.class_idx for r in found.collect()) == [20_007, 20_008, 20_009]


def test_all_misfitting_lengths_are_listed(spark):
    windows = spark.range(80).select(F.array_repeat(F.lit(1.0).cast("float"), F.col("id").cast("int") + 2).alias("embedding"))
    recs = spark.createDataFrame([("r", 0, "x", [1.0], 0.0)], "classifier_name string, class_idx int, label string, beta array<float>, bias float")
    assert recognize.misfits(windows, recs).count() == 80


@pytest.mark.parametrize(
    ("classes", "weights", "biases", "dim"),
    [(["a"], 8, 1, 4), (["a"], 3, 1, 4), (["a", "b"], 8, 1, 4), (None, 4, 1, 4), ([], 4, 1, 4), (["a", "b"], 7, 2, None)],
)
def test_definitions_must_fit(spark, classes, weights, biases, dim):
    schema = "name string, classes array<string>, beta string, beta_bias string, model_config struct<embedding_dim:int>"
    one = spark.createDataFrame([("r", classes, packed([1] * weights), packed([0] * biases), (dim,))], schema)
    with pytest.raises(Exception, match="don't fit together"):
        decode_definitions(one).collect()


def test_fitting_definition(spark):
    schema = "name string, classes array<string>, beta string, beta_bias string, model_config struct<embedding_dim:int>"
    one = spark.createDataFrame([("r", ["a", "b"], packed([1, 2, 3, 4]), packed([5, 6]), (2,))], schema)
    rows = decode_definitions(one).sort("class_idx").collect()
    assert [(r.label, r.beta, r.bias) for r in rows] == [("a", [1.0, 3.0], 5.0), ("b", [2.0, 4.0], 6.0)]


def test_torn_vectors_are_errors(spark):
    torn = spark.createDataFrame([(base64.b64encode(b"12345").decode(),), (base64.b64encode(b"123").decode(),)], "v string").coalesce(1)
    with pytest.raises(Exception, match="whole number"):
        unpack(torn, "v").collect()


def test_store_keeps_names_and_refuses_twins(spark, tmp_path):
    recs = spark.createDataFrame([(1, "007"), (2, "010")], "recording_id long, deployment string")
    windows = spark.createDataFrame([(1, 0, 0, "007"), (1, 0, 0, "007"), (2, 0, 0, "010")], "recording_id long, window_idx int, channel int, deployment string")
    store = WindowStore(spark, str(tmp_path))
    with pytest.raises(Exception, match="repeated"):
        store.add(recs, windows)
    store.add(recs, windows, duplicates="skip")
    store.add(recs, windows, duplicates="skip")
    assert sorted(tuple(r) for r in store.windows.select("recording_id", "deployment").collect()) == [(1, "007"), (2, "010")]


@pytest.mark.parametrize("template", ["/x/{filestem}", "a/../{filestem}", "..\\{filestem}", "\\x{ext}", "{nobody}", "  ", 7])
def test_unsafe_templates(template):
    with pytest.raises(ValueError):
        check_template(template, "classify")


def test_safe_template():
    assert check_template(" {parents}/..x/{filestem}{ext} ", "classify") == "{parents}/..x/{filestem}{ext}"
