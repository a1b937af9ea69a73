import math

import pytest
from pyspark.sql import functions as F

from dawnchorus.operators import classify as c


def raw(score):
    """The logit whose calibrated score is given."""
    return (score + 10) / 0.97


def windows(spark, *vectors):
    rows = [(i, [None if x is None else raw(x) for x in vec] if vec is not None else None) for i, vec in enumerate(vectors)]
    return spark.createDataFrame(rows, "w int, logits array<double>")


def both_ways(df, threshold, top_n, allowed=None):
    spark = df.sparkSession
    array_form = c.top_classes(df, "logits", threshold, top_n, allowed)
    ids = None if allowed is None else spark.createDataFrame([(i,) for i in allowed], "class_idx int")
    long_form = c.top_classes_long(c.explode_logits(df), ["w"], threshold, top_n, ids)

    def listed(d):
        got = d.select("w", "class_idx", F.round("score", 6).alias("s")).collect()
        return sorted(((r["w"], -r["s"], -r["class_idx"]) for r in got))

    a, b = listed(array_form), listed(long_form)
    assert a == b
    return [(w, -i) for w, _, i in a]


def test_hand_values(spark):
    assert both_ways(windows(spark, [0.50, 0.95, 0.10, 0.80, 0.70]), 0.6, 2) == [(0, 1), (0, 3)]
    assert both_ways(windows(spark, [0.9, 0.2, 0.7]), 0.5, 10) == [(0, 0), (0, 2)]
    assert both_ways(windows(spark, [0.1, 0.2, 0.3]), 0.5, 10) == []


def test_allowed_classes_come_before_top_n(spark):
    df = windows(spark, [0.99, 0.98, 0.97, 0.40, 0.39, 0.38])
    assert both_ways(df, 0.35, 2, [2, 3, 4]) == [(0, 2), (0, 3)]
    assert both_ways(df, 0.35, 2, []) == []


def test_nan_null_and_empty_never_pass(spark):
    nan = float("nan")
    df = windows(spark, [nan, 0.9, nan], None, [], [None, 0.8], [nan, nan])
    assert both_ways(df, 0.0, 5) == [(0, 1), (3, 1)]


def test_ties_take_the_higher_class(spark):
    assert both_ways(windows(spark, [0.5, 0.5, 0.5]), 0.0, 2) == [(0, 2), (0, 1)]


def test_without_top_n_all_stay(spark):
    assert len(both_ways(windows(spark, [0.5] * 7, [-1.0] * 7), 0.0, None)) == 7


def test_large_top_n_equals_small_formula(spark):
    df = spark.range(3).select(
        F.col("id").cast("int").alias("w"),
        F.explode(F.sequence(F.lit(0), F.lit(2999))).alias("class_idx"),
    ).withColumn("logit", F.pmod(F.xxhash64("w", "class_idx"), F.lit(1000)).cast("double"))
    got = c.top_classes_long(df, ["w"], -100.0, 1500)
    vectors = df.groupBy("w").agg(F.transform(F.sort_array(F.collect_list(F.struct("class_idx", "logit"))), lambda s: s["logit"]).alias("logits"))
    want = c.top_classes(vectors, "logits", -100.0, 1500)
    cols = ["w", "class_idx"]
    assert got.count() == 4500
    assert got.select(cols).exceptAll(want.select(cols)).isEmpty()


def test_width_mismatch(spark):
    names = spark.createDataFrame([(0, "a"), (1, "b")], "class_idx int, label string")
    df = windows(spark, [0.5, 0.5, 0.5])
    with pytest.raises(ValueError, match="width"):
        c.require_matching_width(df, names)
    with pytest.raises(Exception, match="class names"):
        c.top_classes(df, "logits", 0.0, 3, width=2).collect()
    assert c.top_classes(windows(spark, [0.5] * 3, None), "logits", 0.0, 3, width=3).count() == 3


def test_selection_is_the_same_for_any_partitioning(spark, sf_dir):
    from registered import bindings as b

    seen = set()
    for n in (1, 4, 16):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = b.long_logits(spark, sf_dir).repartition(n)
        got = c.top_classes_long(df, ["window_id"], 0.0, 3, tie_keys=("l_partkey", "l_linenumber"))
        seen.add(got.agg(F.sum(F.xxhash64(*got.columns).cast("decimal(38,0)"))).first()[0])
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert len(seen) == 1


def test_one_window_with_a_third_of_all_rows(spark):
    hot = spark.range(30_000).select(F.lit(0).alias("w"), F.col("id").cast("int").alias("class_idx"))
    cold = spark.range(60_000).select((F.col("id") + 1).cast("int").alias("w"), F.lit(5).alias("class_idx"))
    df = hot.unionByName(cold).withColumn("logit", F.col("class_idx") * 1.0 + 20)
    got = c.top_classes_long(df, ["w"], 0.0, 2)
    assert [r["class_idx"] for r in got.where("w = 0").orderBy(F.desc("score")).collect()] == [29999, 29998]
    assert got.count() == 60_002
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_array_form_shuffles_nothing(spark, sf_dir):
    from registered import bindings as b

    df = b.windows(spark, sf_dir).drop("label").withColumnRenamed("embedding", "logits")
    plan = c.top_classes(df, "logits", -10.0, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "array_max" in plan


def test_brute_force_with_repeated_windows(spark):
    import numpy as np

    rng = np.random.default_rng(11)
    vectors = [rng.normal(10.5, 1.0, size=40).astype("float32") for _ in range(30)]
    vectors[3][5] = np.nan
    # Window 1 twice alike; window 2 twice with different logits.
    keys = [*range(30), 1, 2]
    all_vectors = [*vectors, vectors[1], vectors[7]]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in zip(keys, all_vectors)], "w int, logits array<float>")
    want = []
    for k, v in zip(keys, all_vectors):
        score = v.astype("float64") * 0.97 - 10
        order = sorted((i for i in range(40) if score[i] >= 0.0), key=lambda i: (-score[i], -i))
        want += [(k, i) for i in order[:4]]
    got = [(r["w"], r["class_idx"]) for r in c.top_classes(df.repartition(5), "logits", 0.0, 4).collect()]
    assert sorted(got) == sorted(want)


def pairs(spark, *rows):
    return spark.createDataFrame([(i, s, d) for i, (s, d) in enumerate(rows)], "ord int, src string, dst string")


def resolve(spark, labels, names=None, codes=None):
    classes = spark.createDataFrame(list(enumerate(labels)), "class_idx int, label string")
    out = c.resolve_class_names(classes, names, codes)
    return [r["label"] for r in out.orderBy("class_idx").collect()]


def test_names_through_species_codes(spark):
    codes = pairs(spark, ("bkfqua1", "quailf1"), ("bkhcan1", "bkhcan2"))
    names = pairs(spark, ("quailf1", "ortygospiza atricollis"), ("bkhcan2", "serinus alario"))
    assert resolve(spark, ["bkfqua1", "bkhcan1"], names, codes) == ["ortygospiza atricollis", "serinus alario"]


def test_name_fallbacks(spark):
    codes = pairs(spark, ("a", "A"), ("b", "B"), ("c", "C"))
    names = pairs(spark, ("A", ""), ("a", "name of a"), ("B", ""), ("d", "old"), ("d", "name of d"))
    assert resolve(spark, ["a", "b", "c", "d", "e"], names, codes) == ["name of a", "B", "C", "name of d", "e"]
    assert resolve(spark, ["a", "x"]) == ["a", "x"]
    assert resolve(spark, ["a", "x"], None, codes) == ["A", "x"]


def test_reverse_takes_the_last(spark):
    got = c.reverse_mapping(pairs(spark, ("n1", "c"), ("n2", "c"), ("n3", "d")))
    assert {(r["src"], r["dst"]) for r in got.collect()} == {("c", "n2"), ("d", "n3")}


def test_class_list_preference(spark):
    a, b = spark.range(1), spark.range(2)
    assert c.pick_class_list({"labels": a, "label": b}) is b
    assert c.pick_class_list({"labels": a, "label": b}, ("labels", "label")) is a
    assert c.pick_class_list({"classes": a}) is a
    assert c.pick_class_list({}) is None


def test_species_are_folded_like_python(spark):
    classes = spark.createDataFrame([(0, "STRASSE"), (1, "Übel"), (2, "x")], "class_idx int, label string")
    species = spark.createDataFrame([("straße",), (" üBEL ",), ("",)], "raw string")
    assert sorted(r.class_idx for r in c.allowed_classes(classes, species).collect()) == [0, 1]


def test_unknown_recording_is_named(spark):
    found = spark.createDataFrame([(1,), (9,), (None,)], "recording_id long")
    recordings = spark.createDataFrame([(1, "x/site1.wav"), (2, "y/site2.wav")], "recording_id long, source string")
    with pytest.raises(ValueError, match="9"):
        c.detection_sources(found, recordings)
    sources = c.detection_sources(found.where("recording_id = 1"), recordings).collect()
    assert [r["source"] for r in sources] == ["x/site1.wav"]


def test_calibration(spark):
    got = spark.range(1).select(c.calibrate(F.lit(12.0))).first()[0]
    assert math.isclose(got, 12.0 * 0.97 - 10)
