import os

import pytest
from pyspark.sql import functions as F

from dawnchorus.sources import audio_tree as a
from dawnchorus.sources.tables import staged_detections


@pytest.fixture()
def tree(tmp_path):
    for name in ["one/a.wav", "one/b.FLAC", "two/c.mp3", "two/deep/d.ogg", "two/notes.txt", "one/with space.Wav", "_two/.e.wav"]:
        path = tmp_path / "audio" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * 7)
    return str(tmp_path / "audio")


def names(df):
    return sorted(r["source"] for r in df.collect())


def test_listing(spark, tree):
    df = a.list_tree(spark, tree)
    assert names(df) == ["_two/.e.wav", "one/a.wav", "one/b.FLAC", "one/with space.Wav", "two/c.mp3", "two/deep/d.ogg"]
    assert {r["source"]: r["depth"] for r in df.collect()}["two/deep/d.ogg"] == 3
    assert df.agg(F.sum("length")).first()[0] == 42


def test_links_add_no_file_twice(spark, tree, tmp_path):
    """Links to the tree, its parent, a neighbour, one another; links out of the tree, two to the same folder; a broken one."""
    far = tmp_path / "far"
    (far / "in").mkdir(parents=True)
    for name in ("f.wav", "in/g.wav"):
        (far / name).write_bytes(b"x")
    plain = names(a.list_tree(spark, tree))
    for name, target in {"loop": tree, "one/up": str(tmp_path), "one/beside": os.path.join(tree, "two"), "two/round": os.path.join(tree, "two", "round"),
                         "gone": str(tmp_path / "nowhere"), "one/alias.wav": os.path.join(tree, "one", "a.wav")}.items():
        os.symlink(target, os.path.join(tree, name))
    found = names(a.list_tree(spark, tree))
    assert [f for f in found if not f.startswith("one/up/")] == sorted([*plain, "one/alias.wav"])
    assert [f for f in found if f.startswith("one/up/")] == ["one/up/far/f.wav", "one/up/far/in/g.wav"]
    os.unlink(os.path.join(tree, "one/up"))
    os.symlink(str(far), os.path.join(tree, "x1"))
    os.symlink(str(far / "in"), os.path.join(tree, "two/x2"))
    os.symlink(str(far), os.path.join(tree, "one/x3"))
    found = names(a.list_tree(spark, tree))
    assert sorted(f.rsplit("/", 1)[1] for f in found if f.endswith(("f.wav", "g.wav"))) == ["f.wav", "g.wav"]
    assert "x1/f.wav" in found and len(found) == len(set(found)) == len(plain) + 3


def test_depth_rule(spark, tree):
    kept, glob, skipped = a.at_shallowest_depth(a.list_tree(spark, tree))
    assert (names(kept), glob, skipped) == (["_two/.e.wav", "one/a.wav", "one/b.FLAC", "one/with space.Wav", "two/c.mp3"], "*/*", 1)


def test_no_audio(spark, tmp_path):
    (tmp_path / "x.txt").write_text("x")
    with pytest.raises(FileNotFoundError):
        a.at_shallowest_depth(a.list_tree(spark, str(tmp_path)))


def test_inputs_of_a_run(spark, tree):
    assert a.input_files(spark, tree)[1] == 5
    assert a.input_files(spark, tree, "*/*/*")[1] == 1
    assert a.input_files(spark, tree, "one/*")[1] == 3
    files, n = a.input_files(spark, os.path.join(tree, "one", "a.wav"))
    assert n == 1 and names(files) == ["a.wav"]


@pytest.mark.parametrize(
    "glob, want",
    [("*", ["a.wav"]), ("*/*", ["b/c.wav", "b/d[1].wav"]), ("b/?.wav", ["b/c.wav"]), ("b/[cx].wav", ["b/c.wav"]),
     ("b/[!c]*", ["b/d[1].wav"]), ("b/d[[]1].wav", ["b/d[1].wav"]), ("a.wav", ["a.wav"]), ("a+wav", [])],
)
def test_globs(spark, glob, want):
    df = spark.createDataFrame([("a.wav",), ("b/c.wav",), ("b/d[1].wav",), ("b/e/f.wav",)], "source string")
    assert names(a.matching_glob(df, glob)) == want


def test_recursive_globs_are_refused():
    with pytest.raises(ValueError, match="recursive"):
        a.glob_regex("**/*.wav")


def test_statistics(spark):
    df = spark.createDataFrame([(10.0,), (None,), (20.0,)], "duration_s double")
    assert tuple(a.manifest_statistics(df).first()) == (3, 30.0, 10.0)
    assert tuple(a.manifest_statistics(df.limit(0)).first()) == (0, 0.0, 0.0)


def test_staged_table_needs_its_columns(spark, tmp_path):
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    df = spark.createDataFrame([("a_0", "1", 0.0, "BirdA", 0.9)], "window_id string, recording_id string, offset_s double, species string, score double")
    df.write.parquet(good)
    df.drop("species", "score").write.parquet(bad)
    assert staged_detections(spark, good).first()["recording_id"] == 1
    with pytest.raises(ValueError, match=r"\['score', 'species'\]"):
        staged_detections(spark, bad)
