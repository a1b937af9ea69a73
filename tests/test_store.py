import re

import pytest
from pyspark.sql import functions as F

from dawnchorus.operators import store as s
from dawnchorus.streaming.incremental import add_arrivals


def recordings(spark, *sources):
    return s.with_recordings(spark.createDataFrame([(x,) for x in sources], "source string"), "search_set")


def windows(recs, n=3):
    return recs.select(
        "recording_id", "deployment", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("window_idx"), F.lit(0).alias("channel")
    ).withColumn("offset_s", F.col("window_idx") * 5.0).withColumn("embedding", F.array(F.lit(1.0).cast("float")))


def test_deployments(spark):
    got = {r["source"]: r["deployment"] for r in recordings(spark, "a.wav", "site/b.wav", "site/day/c.wav").collect()}
    assert got == {"a.wav": "search_set", "site/b.wav": "site", "site/day/c.wav": "site"}


def test_ids_are_stable_and_checked(spark):
    first, again = recordings(spark, "a.wav", "b.wav"), recordings(spark, "b.wav", "a.wav")
    assert first.select("recording_id", "source").exceptAll(again.select("recording_id", "source")).isEmpty()
    s.require_unique_ids(first)
    with pytest.raises(ValueError, match="shared"):
        s.require_unique_ids(first.withColumn("recording_id", F.lit(1)))


def test_additions(spark, tmp_path):
    kept = s.WindowStore(spark, str(tmp_path / "store"))
    assert not kept.exists() and kept.windows is None
    first = recordings(spark, "x/a.wav")
    kept.add(first, windows(first))
    both = recordings(spark, "x/a.wav", "y/b.wav")
    with pytest.raises(ValueError, match="already in the store"):
        kept.add(both, windows(both))
    assert kept.windows.count() == 3 and kept.recordings.count() == 1
    kept.add(both, windows(both, 4), duplicates="skip")
    assert kept.windows.count() == 8 and kept.recordings.count() == 2
    fresh = recordings(spark, "y/c.wav")
    kept.add(fresh, windows(fresh))
    assert kept.windows.count() == 11
    kept.add(fresh, windows(fresh), duplicates="allow")
    assert kept.windows.count() == 14 and kept.recordings.count() == 3
    with pytest.raises(ValueError):
        kept.add(fresh, windows(fresh), duplicates="maybe")


def test_deployment_prunes_files(spark, tmp_path):
    kept = s.WindowStore(spark, str(tmp_path / "store"))
    recs = recordings(spark, "x/a.wav", "y/b.wav")
    kept.add(recs, windows(recs))
    plan = kept.windows.where("deployment = 'x'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(deployment" in plan


def test_unknown_recordings(spark):
    recs = recordings(spark, "a.wav", "b.wav")
    w = windows(recs)
    known = recs.where("source = 'a.wav'")
    assert s.unknown_recordings(w, known).first()["n_windows"] == 3
    with pytest.raises(KeyError):
        s.require_known_recordings(w, known)
    s.require_known_recordings(w, recs)


def test_summary(spark):
    recs = recordings(spark, "a.wav")
    assert tuple(s.run_summary(windows(recs), 1800.0, 9.0).first()) == (3, 1800.0, 9.0, 18.0)
    assert s.run_summary(windows(recs), 0.0, 9.0).first()["elapsed_s_per_audio_hour"] is None


def test_stream_adds_each_file_once(spark, tmp_path):
    incoming, root, mark = (str(tmp_path / n) for n in ("in", "store", "mark"))
    recs = recordings(spark, "x/a.wav")
    rows = windows(recs).join(recs.drop("deployment"), "recording_id")
    rows.write.mode("append").parquet(incoming)
    add_arrivals(spark, incoming, rows.schema, root, mark)
    add_arrivals(spark, incoming, rows.schema, root, mark)
    kept = s.WindowStore(spark, root)
    assert kept.windows.count() == 3
    more = recordings(spark, "y/b.wav", "x/a.wav")
    windows(more, 4).join(more.drop("deployment"), "recording_id").write.mode("append").parquet(incoming)
    add_arrivals(spark, incoming, rows.schema, root, mark)
    assert kept.windows.count() == 8 and kept.recordings.count() == 2


def test_known_recordings_open_only_their_partitions(spark, tmp_path):
    kept = s.WindowStore(spark, str(tmp_path / "store"))
    for site in "abcd":
        recs = recordings(spark, f"{site}/1.wav", f"{site}/2.wav")
        kept.add(recs, windows(recs))
    ids = recordings(spark, "c/2.wav", "new/9.wav").select("recording_id")
    found = kept.windows_of(ids)
    assert found.count() == 3
    text = found._jdf.queryExecution().executedPlan().toString()
    (scan,) = [line for line in text.splitlines() if "FileScan" in line and "embedding" in line]
    assert re.search(r"PartitionFilters: \[[^\]]*deployment#\d+ = c\b", scan)
    assert {f.split("addition=")[1][:32] for f in found.inputFiles() if "/windows/" in f} == {kept.additions()[2]}
    assert kept.windows_of(recordings(spark, "new/9.wav").select("recording_id")) is None


def test_failure_between_the_tables_leaves_the_old_store(spark, tmp_path, monkeypatch):
    kept = s.WindowStore(spark, str(tmp_path / "store"))
    first = recordings(spark, "x/a.wav")
    kept.add(first, windows(first))
    more = recordings(spark, "y/b.wav")
    broken = windows(more).withColumn("offset_s", F.raise_error(F.lit("boom")).cast("double"))
    with pytest.raises(Exception, match="boom"):
        kept.add(more, broken)
    assert kept.version() == 1 and kept.recordings.count() == 1 and kept.windows.count() == 3
    assert len(kept.remove_uncommitted()) == 1 and kept.remove_uncommitted() == []
    kept.add(more, windows(more))
    assert kept.version() == 2 and kept.recordings.count() == 2 and kept.windows.count() == 6
    assert kept.windows_at(1).count() == 3 and kept.recordings_at(1).count() == 1


def test_of_two_writers_one_is_refused(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    one, other = s.WindowStore(spark, root), s.WindowStore(spark, root)
    a, b = recordings(spark, "x/a.wav"), recordings(spark, "y/b.wav")
    commit = one._commit

    def late(base, additions):
        other.add(b, windows(b))  # commits while the first is still writing
        commit(base, additions)

    monkeypatch.setattr(one, "_commit", late)
    with pytest.raises(s.ConcurrentAddition):
        one.add(a, windows(a))
    assert other.version() == 1 and other.recordings.select("source").collect()[0][0] == "y/b.wav"
    monkeypatch.undo()
    assert one.add(a, windows(a)) == 3
    assert one.version() == 2 and one.windows.count() == 6


def test_index_counts_windows(spark, tmp_path):
    kept = s.WindowStore(spark, str(tmp_path / "store"))
    assert kept.counts().count() == 0
    both = recordings(spark, "x/a.wav", "b.wav")
    assert kept.add(both, windows(both, 4)) == 8
    assert kept.add(both, windows(both, 6), duplicates="skip") == 4
    assert kept.add(both, windows(both, 6), duplicates="skip") == 0
    assert {(r["deployment"], r["n_windows"]) for r in kept.counts().collect()} == {("x", 6), ("search_set", 6)}


def test_null_deployments_are_found_again(spark, tmp_path):
    kept = s.WindowStore(spark, str(tmp_path / "store"))
    recs = recordings(spark, "x/a.wav").withColumn("deployment", F.lit(None).cast("string"))
    kept.add(recs, windows(recs))
    with pytest.raises(ValueError, match="already in the store"):
        kept.add(recs, windows(recs))
