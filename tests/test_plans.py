import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinewave.operators import training
from brinewave.plans import dataset_build, evaluation
from brinewave.sources import tables, wav
from brinewave.streaming import incremental

S = 1_000_000
START = 1577836800 * S


@pytest.fixture()
def table(spark, archive, tmp_path):
    root, signals = archive
    dataset_build.ingest(spark, root, str(tmp_path / "chunks"))
    return spark.read.parquet(str(tmp_path / "chunks")), signals


def test_test_set_from_archive(spark, table, tmp_path):
    chunks, signals = table
    (tmp_path / "c.json").write_text(json.dumps({"set": {"root_dir": "data", "stations": {
        "NORTH": {"date_start": "20200101_000000", "date_end": "20200101_001005"},
        "SOUTH": {"date_start": "20200101_000000", "date_end": "20200101_001000"}}}}))
    (tmp_path / "a.csv").write_text(
        "station,class,date,n\nNORTH,T,20200101_000030,3\nNORTH,T,20200101_000030,3\nNORTH,H,20200101_000140,1\nSOUTH,uncertain,20200101_000900,2\n"
    )
    stations = tables.read_dataset_config(spark, str(tmp_path / "c.json"))
    notes = tables.read_test_annotations(spark, str(tmp_path / "a.csv"))
    manifest = dataset_build.tile_manifest(dataset_build.labelled_test_tiles(notes, stations), "out", "npy")
    for _ in range(2):
        got = dataset_build.build(manifest, chunks, "waveform", str(tmp_path / "out"))
    assert got["features"].count() == got["manifest"].count() == 6 + 3
    # one tile lies in a gap, and the second station's period runs past its recording
    assert sorted(r.reason for r in got["rejected"].collect()) == ["after the last file"] * 2 + ["no samples"]
    first = got["features"].where("path like '%NORTH/20200101_000050%'").first()
    assert first.label == "positive" and len(first.waveform) == 23998
    assert first.waveform == signals[("NORTH", "20200101_000000")][:23998].tolist()
    picks = got["manifest"].where("path like '%NORTH/20200101_000050%'").first().picks
    assert [(p.offset_s, p.n_annotators, p.copies) for p in picks] == [(-20.0, 3, 2), (50.0, 1, 1)]
    assert got["manifest"].where("label = 'positive'").count() == 1
    assert all(abs(r.coverage - 1) < 0.01 for r in got["manifest"].collect())
    tiled = dataset_build.build(manifest, chunks, "waveform", str(tmp_path / "tiled"), tiling=stations)["features"]
    assert {r.path: r.waveform for r in tiled.collect()} == {r.path: r.waveform for r in got["features"].collect()}


def test_tiled_features_move_samples_once(spark, table):
    from brinewave.operators import segments as seg
    from brinewave.operators.features import segment_features

    chunks, _ = table
    period = spark.createDataFrame([("NORTH", START, START + 600 * S)], "station string, start_us bigint, end_us bigint")
    tiles = seg.tiles(period, 100 * S).select("station", "seg_start_us", "seg_end_us")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = segment_features(tiles, chunks, "energy", 240, 100 * S, tiling=period)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # chunks and stations by station (no broadcast here), samples by tile, tiles by tile
    assert plan.count("Exchange hashpartitioning(") == 4
    assert df.count() == 6


def test_energy_and_image_features(spark, table, tmp_path):
    chunks, signals = table
    manifest = spark.createDataFrame(
        [("p1", "NORTH", START + 250 * S, START + 350 * S, "positive", [])],
        "path string, station string, seg_start_us bigint, seg_end_us bigint, label string, "
        "picks array<struct<offset_s:double,n_annotators:int,copies:bigint>>",
    )
    share = dataset_build.build(manifest, chunks, "energy", str(tmp_path / "e"))["features"].first().share
    assert len(share) == 8 and sum(share) == pytest.approx(1.0)
    image = dataset_build.build(manifest, chunks, "image", str(tmp_path / "i"))["features"].first().pixels
    assert np.array(image).shape == (129, 186)


def test_training_segments(spark, tmp_path):
    rows = [("A", 1, "positive", 100 * S), ("A", 2, "positive", 103 * S), ("A", 3, "negative", 500 * S)]
    notes = spark.createDataFrame(rows, "station string, event_id int, label string, at_us bigint")
    segs = dataset_build.training_segments(notes, multiplier=0.0)
    got = {r.event_id: r for r in dataset_build.training_manifest(segs, "out", "png").collect()}
    assert [p.offset_s for p in got[1].picks] == [0.0, 3.0]
    assert [p.offset_s for p in got[2].picks] == [0.0, -3.0]
    assert got[3].picks == [] and got[3].seg_end_us - got[3].seg_start_us == 100 * S
    assert got[3].path == "out/negatives/A/19700101_000820.png"


def labelled(spark):
    picks = "picks array<struct<offset_s:double,n_annotators:int,copies:bigint>>"
    rows = [
        (0, "positive", [(0.0, 3, 1)]),
        (1, "positive", [(-30.0, 3, 1), (20.0, 1, 1)]),
        (2, "positive", [(5.0, 1, 1)]),
        (3, "negative", []),
    ]
    return spark.createDataFrame(rows, f"seg_id int, label string, {picks}")


def test_segmenter_that_copies_the_truth(spark):
    from brinewave.functions.curves import objective_curve

    rows = labelled(spark)
    truth = objective_curve(F.transform("picks", lambda p: p["offset_s"]), 186, 100.0, 10.0)
    got = evaluation.evaluate_segmenter(rows, truth, 186, min_annotators=3)
    totals = got["totals"].first()
    # segment 2 lost its only pick to the quorum, so its detection is false
    assert (totals.p, totals.n, totals.tp, totals.fp, totals.tn) == (2, 2, 2, 1, 1)
    assert got["counts"].first().n_truths == 2 and got["counts"].first().n_detections == 4
    assert {r.residual for r in got["true_peaks"].collect()} == {0.0}
    assert got["residuals"].where("share > 0").collect()[0].share == 1.0
    assert got["roc"].where("thr = 0").first().tpr == 1.0
    assert sum(r.n_false for r in got["peak_scores"].collect()) == 2


def test_segmenter_with_a_supplied_predictor(spark):
    def same():
        return lambda x: x

    from brinewave.functions.curves import objective_curve

    rows = labelled(spark)
    truth = objective_curve(F.transform("picks", lambda p: p["offset_s"]), 186, 100.0, 10.0)
    ready = rows.withColumn("x", truth).cache()
    prediction = training.batch_predict(same, F.col("x"), 186, curve=True)
    got = evaluation.evaluate_segmenter(ready, prediction, 186)
    totals = got["totals"].first()
    assert (totals.p, totals.n, totals.tp, totals.fn, totals.fp) == (3, 1, 3, 0, 0)
    assert got["scores"].first().accuracy == 1.0


def test_spectrogram_of_a_named_event(spark, table):
    from brinewave.operators.features import segment_features
    from brinewave.operators.segments import requested_segments

    chunks, _ = table
    events = spark.createDataFrame([("e", "NORTH", 75, START + 290 * S)], "name string, station string, duration_s int, center_us bigint")
    asked = requested_segments(events).select("name", "station", "seg_start_us", "seg_end_us")
    r = segment_features(asked, chunks, "spectrogram", 240, 100 * S, vmin=60.0, vmax=140.0).first()
    grid = np.array(r.spectro)
    assert grid.shape == (129, (75 * 240 - 2 - 256) // 128 + 1) and grid.min() >= 60.0


def test_trees_end_to_end(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(i % 3 == 0), (rng.normal(size=4) + 3 * (i % 3 == 0)).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "seg_id int, y int, share array<double>")
    from brinewave.operators.folds import assign_folds

    parts = assign_folds(df, "seg_id", "y", 2)
    aucs = training.cross_validate(parts, "share", "y", "seg_id", 2, trees=2, rate=0.3, depth=2).collect()
    assert [r.n_trees for r in aucs] == [2, 2] and all(r.auc > 0.9 for r in aucs)
    trials = training.search(parts, "share", "y", "seg_id", training.draw_trials(2, trees=(1, 3)), 2)
    best = training.best_trial(trials).first()
    assert best.loss == min(r.loss for r in trials.collect())
    model = training.fit_trees(parts, "share", "y", "seg_id", 2, 0.3, 2)
    noted = df.select(
        "seg_id", "share", F.when(F.col("y") == 1, "positive").otherwise("negative").alias("label"),
        F.expr("if(y = 1, array(named_struct('offset_s', 0D, 'n_annotators', 2, 'copies', 1L)), array())").alias("picks"),
    )
    got = evaluation.evaluate_classifier(noted, model)
    assert got["auc"].first().auc > 0.95
    assert got["scored"].count() == 90 and got["roc"].count() == 1001
    strict = evaluation.evaluate_classifier(noted, model, min_annotators=3)
    assert strict["scored"].agg(F.sum("truth")).first()[0] == 0
    assert strict["auc"].first().auc is None


def test_trials_stay_in_the_space():
    trials = training.draw_trials(50, seed=1)
    assert trials == training.draw_trials(50, seed=1)
    assert all(1 <= t <= 10_000 and 0.01 <= r <= 1.0 for _, t, r in trials)


def test_predicted_curve(spark):
    def double():
        return lambda x: x * 2

    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "x array<double>")
    got = df.select(training.batch_predict(double, F.col("x"), 2, curve=True).alias("y")).collect()
    assert [r.y for r in got] == [[2.0, 4.0], [6.0, 8.0]]


def test_streaming_ingest_takes_each_file_once(spark, archive, tmp_path):
    root, _ = archive
    table, mark = str(tmp_path / "t"), str(tmp_path / "mark")
    incremental.ingest_new(spark, root, table, mark).awaitTermination()
    n = spark.read.parquet(table).count()
    assert n == wav.decode_chunks(wav.list_files(spark, root)).count()
    (tmp_path / "data" / "WEST").mkdir()
    (tmp_path / "data" / "WEST" / "20200101_000000.wav").write_bytes(wav.encode_pcm16([1, 2, 3], 240))
    incremental.ingest_new(spark, root, table, mark).awaitTermination()
    assert spark.read.parquet(table).count() == n + 1


def test_streaming_auc_state_equals_batch(spark, tmp_path):
    from brinewave.operators.scoring import auc_counts, auc_from_counts

    rows = spark.range(400).select(
        (F.col("id") % 2).cast("int").alias("truth"), ((F.col("id") * 37 % 101 + 30 * (F.col("id") % 2)) / 131).alias("score")
    )
    rows.repartition(4).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    q = (
        incremental.running_auc_counts(stream)
        .writeStream.outputMode("complete").format("memory").queryName("auc_state")
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    got = auc_from_counts(spark.table("auc_state")).first().auc
    assert got == pytest.approx(auc_from_counts(auc_counts(rows)).first().auc)
