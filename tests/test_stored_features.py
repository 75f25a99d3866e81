"""Bucketed features and stored frames: what the plans read and move."""

import pytest

from brinewave.operators import spectral
from brinewave.sources import sinks
from brinewave.sources.tables import join_features

HOUR = 3_600_000_000
KEYS = ["label", "file", "idx"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def vectors(spark, n=200):
    rows = [("positive" if i % 3 else None, f"s{i % 7}.npy", i, [float(i), 1.0]) for i in range(n)]
    return spark.createDataFrame(rows, "label string, file string, idx long, samples array<double>")


def test_stored_vectors_are_joined_where_they_lie(spark, tmp_path, no_broadcast):
    path = str(tmp_path / "features")
    stored = sinks.write_buckets(vectors(spark), "features_one", path, KEYS, 4)
    manifest = spark.createDataFrame([("positive", f"s{i % 7}.npy", i, i % 2) for i in range(0, 200, 5)], "label string, file string, idx long, y int")
    joined = join_features(manifest, stored)
    plan = plan_of(joined)
    assert plan.count("Exchange hashpartitioning") == 1 and "SelectedBucketsCount: 4 out of 4" in plan
    assert {r.idx: r.samples for r in joined.collect()} == {i: [float(i), 1.0] for i in range(0, 200, 5) if i % 3}
    # another session knows the folder, not the table
    spark.sql("DROP TABLE features_one")
    again = sinks.open_buckets(spark, "features_two", path, KEYS, 4)
    assert again.count() == 200 and plan_of(join_features(manifest, again)).count("Exchange hashpartitioning") == 1
    spark.sql("DROP TABLE features_two")


def test_only_requested_hours_are_read(spark, tmp_path):
    rows = [(s, h * HOUR + k * 60_000_000, 0, 1.0, float(k)) for s in (1, 2, 3) for h in range(10) for k in range(60)]
    frames = spark.createDataFrame(rows, "station long, frame_us long, f_bin int, f double, v double")
    sinks.write_frames(frames, str(tmp_path / "frames"))
    asked = spark.createDataFrame(
        [("a", 1, 3 * HOUR + 60_000_000, 600_000_000), ("b", 2, 5 * HOUR + 1_800_000_000, 600_000_000), ("none", 9, 0, 600_000_000)],
        "request string, station long, center_us long, length_us long",
    )
    # requests come from a table, as Spark prunes by tables and not by local rows
    asked.write.parquet(str(tmp_path / "asked"))
    requests = spark.read.parquet(str(tmp_path / "asked")).where("center_us >= 0")
    stored = spark.read.parquet(str(tmp_path / "frames"))
    seen = spectral.stored_viewport(stored, requests, 0.5, 2.0)
    assert "dynamicpruning" in plan_of(seen)
    want = spectral.viewport(frames, asked, 0.5, 2.0, HOUR)
    key = lambda r: (r.request, r.station, r.t_rel, r.f_bin, r.v)
    assert sorted(map(key, seen.collect())) == sorted(map(key, want.collect())) and want.count() == 22
    files = seen.select("request").distinct()
    assert files.count() == 2


def test_only_requested_rows_are_transformed(spark):
    rows = spark.createDataFrame([(s, i, i * 10, i * 10 + 10) for s in (1, 2) for i in range(100)], "station long, i int, lo long, hi long")
    asked = spark.createDataFrame([("a", 1, 305, 20), ("b", 1, 310, 20), ("c", 2, 0, 4)], "request string, station long, center_us long, length_us long")
    got = {(r.station, r.i) for r in spectral.requested_only(rows, asked, "lo", "hi", 20).collect()}
    touched = {(s, i) for _, s, c, n in [("a", 1, 305, 20), ("b", 1, 310, 20), ("c", 2, 0, 4)] for i in range(100) if i * 10 <= c + n / 2 and i * 10 + 10 >= c - n / 2}
    assert touched <= got and len(got) < 20
    assert spectral.requested_only(rows, asked, "lo", "hi", 20).count() == len(got)
