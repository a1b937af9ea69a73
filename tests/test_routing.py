import warnings

import pytest
from pyspark.sql import functions as F

from dawnchorus.functions.text import file_stem, file_suffix
from dawnchorus.operators import routing as r


def rendered(spark, source, template, kind="classify", filetype="csv", **kw):
    df = spark.createDataFrame([(source,)], "source string")
    return df.select(r.destination(F.col("source"), template, kind, filetype, **kw)).first()[0]


def test_hand_values(spark):
    assert rendered(spark, "some/folder/myfile.wav", "{parents}/{filestem}{ext}") == "some/folder/myfile.csv"
    assert rendered(spark, "my.file.name.wav", "{filestem}{ext}", filetype="parquet") == "my.file.name.parquet"


def test_all_layouts(spark):
    want = {
        "nested_filestem": "a/b/x.csv", "flat_filestem": "x.csv",
        "nested": "a/b/classify_results.csv", "flat": "classify_results.csv",
    }
    for name, path in want.items():
        assert rendered(spark, "a/b/x.wav", r.resolve_layout(layout=name)) == path
    assert rendered(spark, "x.wav", r.LAYOUTS["nested"]) == "classify_results.csv"
    assert r.resolve_layout() == "{analysis}{ext}"


def test_tokens_of_each_kind(spark):
    assert rendered(
        spark, "a/x.wav", "{embeddings_table_format}/{parents}/{filestem}/{analysis}{ext}", "embeddings", "parquet",
        table_format="columns",
    ) == "columns/a/x/embeddings.parquet"
    assert rendered(
        spark, "a/x.wav", "{classifier_name}/{analysis}{ext}", "recognizer", classifier_name=F.lit("koala")
    ) == "koala/recognizer_results.csv"
    with pytest.raises(ValueError, match="no value"):
        rendered(spark, "a.wav", "{classifier_name}{ext}", "recognizer")


def test_extension_rules(spark):
    assert rendered(spark, "x.wav", "{filestem}") == "x.csv"
    assert rendered(spark, "x.wav", "out.csv") == "out.csv"
    with pytest.warns(UserWarning, match="appended"):
        assert rendered(spark, "x.wav", "out.parquet") == "out.parquet.csv"
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert rendered(spark, "my.file.wav", "{filestem}") == "my.file.csv"


def test_separators(spark):
    assert rendered(spark, "x.wav", "a\\\\b//{filestem}{ext}") == "a/b/x.csv"
    assert rendered(spark, "./a//x.wav", "{parents}/{filestem}{ext}") == "a/x.csv"


def test_values_are_not_scanned_again(spark):
    assert rendered(spark, "{ext}.wav", "{filestem}{ext}") == "{ext}.csv"


@pytest.mark.parametrize(
    "template, message",
    [("", "empty"), ("  ", "empty"), ("/a{ext}", "relative"), ("\\a{ext}", "relative"), ("a/../b", "'..'"),
     ("{nope}{ext}", "unknown path tokens"), (None, "string")],
)
def test_bad_templates(template, message):
    with pytest.raises(ValueError, match=message):
        r.check_template(template, "classify")


def test_tokens_per_kind():
    with pytest.raises(ValueError):
        r.check_template("{classifier_name}", "classify")
    with pytest.raises(ValueError):
        r.check_template("{embeddings_table_format}", "recognizer")
    with pytest.raises(ValueError):
        r.check_template("x", "other")
    with pytest.raises(ValueError):
        r.resolve_layout("a", "flat")
    with pytest.raises(ValueError):
        r.resolve_layout(layout="deep")


def test_unsafe_sources(spark):
    df = spark.createDataFrame([("a/b.wav",), ("/a.wav",), ("../a.wav",), ("a/..",), ("a..b/c.wav",)], "source string")
    assert {x[0] for x in r.unsafe(df, "source").collect()} == {"/a.wav", "../a.wav", "a/.."}
    with pytest.raises(ValueError, match="relative"):
        r.require_safe(df)


def test_stems_like_a_path_library(spark):
    from pathlib import PurePosixPath

    names = ["a.wav", ".hidden", "a.b.c", "noext", "a.", "..x", "d/e.f", "d.e/f", "a b.w v", "x.wav/", ".a.b"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    rows = df.select("n", file_stem(F.col("n")).alias("stem"), file_suffix(F.col("n")).alias("suffix")).collect()
    for row in rows:
        p = PurePosixPath(row["n"])
        assert (row["stem"], row["suffix"]) == (p.stem, p.suffix), row
