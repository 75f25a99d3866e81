import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinewave.operators import segments as seg
from brinewave.operators.archive import archive_frames
from brinewave.sources import sinks, tables, wav

S = 1_000_000
START = 1577836800 * S  # 2020-01-01


def test_discover_stops_at_stations_and_depth(spark, tmp_path):
    def touch(path):
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x")

    for path in ("r/A/1.wav", "r/A/deep/2.wav", "r/net/B/1.wav", "r/net/x/C/1.wav", "r/net/x/y/D/1.wav", "r/E/no.txt"):
        touch(path)
    root = str(tmp_path / "r")
    found = wav.discover_stations(wav.list_files(spark, root).select("path", "length"), root)
    assert sorted(r.station for r in found.collect()) == ["A", "B", "C"]


def test_catalog(spark, archive):
    root, signals = archive
    rows = wav.file_catalog(wav.list_files(spark, root)).orderBy("station", "start_us").collect()
    assert [(r.station, r.n_samples, r.fs, r.bits) for r in rows] == [
        ("NORTH", 72000, 240, 16), ("NORTH", 72000, 240, 16), ("SOUTH", 48000, 240, 16), ("SOUTH", 31217, 240, 16),
    ]
    assert rows[0].start_us == START and rows[0].end_us == rows[1].start_us
    assert rows[3].end_us == rows[3].start_us + round(31217 / 240 * 1e6)


def test_listing_does_not_read_payloads(spark, archive):
    root, _ = archive
    plan = wav.list_files(spark, root).select("path", "length")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_header_with_other_chunks_and_widths():
    body = struct.pack("<4h", 1, -2, 3, -4)
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, 100, 200, 2, 16)
    extra = struct.pack("<4sI", b"LIST", 3) + b"abc\0"
    data = b"RIFF" + struct.pack("<I", 0) + b"WAVE" + fmt + extra + struct.pack("<4sI", b"data", 8) + body
    fs, bits, x = wav.decode_pcm(data)
    assert (fs, bits, x.tolist()) == (100, 16, [1, -2, 3, -4])
    three = b"RIFF" + struct.pack("<I", 0) + b"WAVE" + struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, 100, 300, 3, 24)
    three += struct.pack("<4sI", b"data", 6) + b"\xff\xff\xff\x01\x00\x00"
    assert wav.decode_pcm(three)[2].tolist() == [-256, 256]  # upper bytes of 32 bits
    with pytest.raises(ValueError):
        wav.walk_header(b"nothing")


@pytest.mark.parametrize("chunk_s", [1, 7, 100])
def test_segments_do_not_depend_on_the_chunk_length(spark, archive, chunk_s):
    root, signals = archive
    chunks = wav.decode_chunks(wav.list_files(spark, root), chunk_s=chunk_s)
    asked = [("NORTH", 0, 100), ("NORTH", 250, 350), ("NORTH", 299.5, 300.5), ("SOUTH", 150, 250), ("SOUTH", 180, 320), ("SOUTH", 210, 290)]
    rows = [(s, int(START + a * S), int(START + b * S)) for s, a, b in asked]
    segments = spark.createDataFrame(rows, "station string, seg_start_us bigint, seg_end_us bigint")
    got = {(r.station, r.seg_start_us): r.samples for r in seg.segment_samples(segments, chunks, 100 * S).collect()}
    first = {"NORTH": [0, 300], "SOUTH": [0, 300]}
    for station, a, b in rows:
        want = []
        for off in first[station]:
            x = signals[(station, "20200101_000000" if off == 0 else "20200101_000500")]
            f0 = START + off * S
            f1 = f0 + round(len(x) / 240 * 1e6)
            head = max(int((a - f0) / 1e6 * 240), 0)
            tail = max(int((f1 - (b - 10_000)) / 1e6 * 240), 0)
            want.extend(x[head : max(len(x) - tail, 0)].tolist())
        assert got.get((station, a), []) == want
    assert len(got[("NORTH", START)]) == 23998
    assert len(got[("NORTH", START + 250 * S)]) == 23998


def test_waveform_table_round_trip(spark, archive, tmp_path):
    root, _ = archive
    chunks = wav.decode_chunks(wav.list_files(spark, root), chunk_s=50)
    sinks.write_chunks(chunks, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == chunks.count()
    pruned = back.where("station = 'NORTH' and date = '2020-01-01'").select("fs")
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(station" in plan and "samples" not in plan


@pytest.mark.parametrize("chunk_s", [16, 64, 100, 7.3, 1000])
def test_archive_frames_equal_whole_file_frames(spark, archive, chunk_s):
    from brinewave.functions.kernels import power_frames

    root, signals = archive
    chunks = wav.decode_chunks(wav.list_files(spark, root), chunk_s=chunk_s).where("station = 'SOUTH'")
    rows = archive_frames(chunks, 240).groupBy("frame_us").agg(F.array_sort(F.collect_list(F.struct("f_bin", "v"))).alias("l"))
    got = {r.frame_us: [v for _, v in r.l] for r in rows.collect()}
    n = 0
    for stamp, off in (("20200101_000000", 0), ("20200101_000500", 300)):
        p = power_frames(signals[("SOUTH", stamp)][None].astype(float), 240.0, 256, 128)[0]
        n += len(p)
        for k, frame in enumerate(p):
            at = START + off * S + round((128 + 128 * k) / 240 * 1e6)
            near = [u for u in (at - 1, at, at + 1) if u in got][0]
            assert np.allclose(got[near], 10 * np.log10(frame + 1e-20))
    assert len(got) == n


def test_manifest_layouts(spark):
    def parse(line, layout):
        df = spark.createDataFrame([(line,)], "value string")
        r = tables.parse_manifest(df, layout).first()
        return r.path, r.idx, r.label, [(p.offset_s, p.n_annotators) for p in r.picks]

    assert parse("a/b.png,positive,1.5,2,-3.0,1", "test") == ("a/b.png", None, "positive", [(1.5, 2), (-3.0, 1)])
    assert parse("a/b.png,negative", "test") == ("a/b.png", None, "negative", [])
    assert parse("a/b.png,positive,1.5,2.5", "train") == ("a/b.png", None, "positive", [(1.5, None), (2.5, None)])
    assert parse("a/S.npy,17,positive,0.1,3", "indexed_test") == ("a/S.npy", 17, "positive", [(0.1, 3)])
    assert parse("a/S.npy,17,negative", "indexed_train") == ("a/S.npy", 17, "negative", [])
    assert parse('"a,b ""c"".png",positive,1.0', "train") == ('a,b "c".png', None, "positive", [(1.0, None)])


def test_a_hot_moment_is_a_short_line(spark, tmp_path):
    pick = "array(named_struct('offset_s', 1.5D, 'n_annotators', 2, 'copies', 1000000L), named_struct('offset_s', -3D, 'n_annotators', 1, 'copies', 1L))"
    for counted, layout in ((True, "test"), (False, "train")):
        df = spark.range(1).select(F.lit("a.png").alias("path"), F.lit("positive").alias("label"), F.expr(pick).alias("picks"))
        sinks.write_manifest_csv(df, str(tmp_path / layout), counted, runs=True)
        line = spark.read.text(str(tmp_path / layout)).first().value
        assert line == ("a.png,positive,1.5x1000000,2,-3.0,1" if counted else "a.png,positive,1.5x1000000,-3.0")
        back = tables.read_manifest(spark, str(tmp_path / layout), layout).first()
        assert [(p.offset_s, p.copies) for p in back.picks] == [(1.5, 1_000_000), (-3.0, 1)]


def test_manifest_text_round_trip(spark, tmp_path):
    lines = ["x/1.png,positive,1.5,2,1.5,2,3.0,1", "x/2.png,negative"]
    df = tables.parse_manifest(spark.createDataFrame([(v,) for v in lines], "value string"), "test")
    sinks.write_manifest_csv(df, str(tmp_path / "m"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "m")).collect()) == sorted(lines)
    assert tables.path_and_offsets(df).where("path = 'x/1.png'").first().offsets == [1.5, 1.5, 3.0]


def test_annotations(spark, tmp_path):
    (tmp_path / "test.csv").write_text(
        "station,class,date,remark,n\nA,T,20200101_000010,x,3\nA,noise,20200101_000010,x,3\nB,H,20200101_000020,y,z,1\n"
    )
    got = [tuple(r) for r in tables.read_test_annotations(spark, str(tmp_path / "test.csv")).collect()]
    assert got == [("A", "T", START + 10 * S, 3), ("B", "H", START + 20 * S, 1)]
    (tmp_path / "train.csv").write_text(
        "station,class,start,end\nA,geophony,20200101_000010,\nA,negative,20200101_000010,20200101_000020\nA,other,20200101_000010,\n"
    )
    got = [tuple(r) for r in tables.read_train_annotations(spark, str(tmp_path / "train.csv")).collect()]
    assert got == [("A", "positive", START + 10 * S), ("A", "negative", START + 15 * S)]


CONFIG = {"one": {"root_dir": "d", "stations": {"A": {"date_start": "20200101_000000", "date_end": "20200101_001000"}}}}
EVENTS = {
    "e1": {"dataset": "one", "station": "A", "segment_duration_s": "200", "segment_center": "20200101_000200"},
    "e2": {"dataset": "one", "station": "A", "segment_duration_s": "75", "segment_center": "20200101_000300", "arrow_offset": "-46"},
}


def test_configs(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps(CONFIG, indent=1))
    (tmp_path / "e.json").write_text(json.dumps(EVENTS))
    r = tables.read_dataset_config(spark, str(tmp_path / "d.json")).first()
    assert tuple(r) == ("one", "d", "A", START, START + 600 * S)
    events = tables.read_event_config(spark, str(tmp_path / "e.json"))
    got = tables.choose_events(events, ["e2", "e1"]).orderBy("pos").collect()
    assert [(r.name, r.duration_s, r.arrow_offset) for r in got] == [("e2", 75, -46), ("e1", 200, None)]
    yaml = pytest.importorskip("yaml")
    (tmp_path / "d.yaml").write_text(yaml.safe_dump(CONFIG))
    assert tables.read_dataset_config(spark, str(tmp_path / "d.yaml")).first() == r


def test_results_replace_their_own_folder_only(spark, tmp_path):
    path = str(tmp_path / "roc")

    def put(model, value):
        sinks.write_results(
            spark.createDataFrame([(model, "d", 1, value)], "model string, dataset string, min_annot int, tpr double"), path
        )

    put("a", 0.1)
    put("b", 0.2)
    put("a", 0.3)
    assert sorted((r.model, r.tpr) for r in spark.read.parquet(path).collect()) == [("a", 0.3), ("b", 0.2)]
    assert tables.read_results(spark, path, model="b").first().tpr == 0.2


def test_second_build_writes_nothing(spark, tmp_path):
    calls = []

    def compute(todo):
        calls.append(todo.count())
        return todo.withColumn("f", F.lit(1.0))

    wanted = spark.createDataFrame([("A", i) for i in range(5)], "station string, k int")
    for rows in (wanted.where("k < 3"), wanted, wanted):
        sinks.write_new_features(compute, rows, str(tmp_path / "f"), ["station", "k"], ["station"])
    assert calls == [3, 2, 0]
    assert spark.read.parquet(str(tmp_path / "f")).count() == 5


def test_decoder_plug_in(spark, tmp_path):
    folder = tmp_path / "Z"
    folder.mkdir()
    (folder / "20200101_000000.raw").write_bytes(np.arange(30, dtype="<i4").tobytes())
    wav.register_decoder("raw", lambda b: (10, 32, np.frombuffer(b, "<i4")))
    try:
        rows = wav.decode_chunks(wav.list_files(spark, str(tmp_path), "raw"), "raw", chunk_s=1).orderBy("first_sample")
        assert [r.samples for r in rows.collect()] == [list(range(i, i + 10)) for i in (0, 10, 20)]
    finally:
        wav.DECODERS.pop("raw")


def test_feature_key_and_history(spark, tmp_path):
    df = spark.createDataFrame([("x/positives/S.npy", [1.0])], "path string, v array<double>")
    r = tables.feature_key(df).first()
    assert (r.file, r.folder) == ("S.npy", "positives")
    spark.createDataFrame([(0, 1, "loss", 0.5)], "fold int, epoch int, metric string, value double").write.partitionBy(
        "fold"
    ).parquet(str(tmp_path / "h"))
    assert tuple(tables.read_history(spark, str(tmp_path / "h")).first()) == (0, 1, "loss", 0.5)


@pytest.mark.parametrize(
    "bits,tag,values,want",
    [
        (8, 1, [0, 128, 255], [0, 128, 255]),
        (16, 1, [-32768, 5], [-32768, 5]),
        (24, 1, [-1, 8388607], [-256, 8388607 * 256]),
        (32, 1, [-(2**31), 7], [-(2**31), 7]),
        (32, 3, [0.5, -0.25, 1.0], [0.5, -0.25, 1.0]),
        (64, 3, [1e-9, 2.0], [1e-9, 2.0]),
    ],
)
def test_formats(bits, tag, values, want):
    data = wav.encode_wav(values, 50, bits, tag, before=b"x" * 6001)
    assert wav.decode_pcm(data)[:2] == (50, bits) and wav.decode_pcm(data)[2].tolist() == want
    extensible = data[:20] + struct.pack("<H", 0xFFFE) + data[22:]
    with pytest.raises(wav.Unreadable):
        wav.decode_pcm(extensible)


def test_odd_files_are_named_and_left_out(spark, tmp_path):
    folder = tmp_path / "data" / "S"
    folder.mkdir(parents=True)
    good = wav.encode_wav([1, 2, 3], 1, before=b"y" * 9000)
    (folder / "20200101_000000.wav").write_bytes(good)
    (folder / "20200101_000100.wav").write_bytes(b"")
    (folder / "20200101_000200.wav").write_bytes(b"no sound at all")
    (folder / "20200101_000300.wav").write_bytes(wav.encode_wav([1], 1)[:20] + struct.pack("<H", 2) + wav.encode_wav([1], 1)[22:])
    files = wav.list_files(spark, str(tmp_path / "data"))
    for view in (files, files.select("path", "length")):
        assert [r.n_samples for r in wav.file_catalog(view).collect()] == [3]
        assert sorted(r.path[-19:-4] for r in wav.unreadable_files(view).collect()) == ["20200101_000200", "20200101_000300"]
    assert [r.samples for r in wav.decode_chunks(files).collect()] == [[1.0, 2.0, 3.0]]


def test_second_ingest_adds_only_new_files(spark, tmp_path):
    from brinewave.plans.dataset_build import ingest

    folder = tmp_path / "data" / "S"
    folder.mkdir(parents=True)
    (folder / "20200101_000000.wav").write_bytes(wav.encode_wav([1, 2], 1))
    for _ in range(2):
        ingest(spark, str(tmp_path / "data"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    (folder / "20200101_000100.wav").write_bytes(wav.encode_wav([3], 1))
    ingest(spark, str(tmp_path / "data"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_stem_of_any_extension(spark):
    from brinewave.functions.timing import stem

    df = spark.createDataFrame([("a/20200101_000000.flac",), ("a/b.c.d",), ("a/plain",)], "p string")
    assert [r.s for r in df.select(stem("p").alias("s")).collect()] == ["20200101_000000", "b.c", "plain"]


def test_blank_and_short_lines(spark, tmp_path):
    from brinewave.sources import tables

    (tmp_path / "a.csv").write_text("S,T,20200101_000000,3\n\nS\n   \nS,H,bad,x\n")
    got = tables.read_test_annotations(spark, str(tmp_path / "a.csv")).collect()
    assert [(r.station, r["class"], r.n_annotators) for r in got] == [("S", "T", 3), ("S", "H", None)]
    (tmp_path / "m.csv").write_text("x/a.png,positive,1.5,2\n\nlonely\n")
    rows = tables.read_manifest(spark, str(tmp_path / "m.csv"), "test").collect()
    assert [(r.path, r.label, len(r.picks)) for r in rows] == [("x/a.png", "positive", 1), ("lonely", None, 0)]


def test_yaml_configs_of_several_files(spark, tmp_path):
    from brinewave.sources import tables

    (tmp_path / "a.yaml").write_text("# events\nE_1:\n  dataset: d\n  station: 'ELAN'\n  segment_duration_s: 750\n  segment_center: 20200606_153730\n\nE_2:\n  dataset: d\n  arrow_offset: 3 # later\n")
    (tmp_path / "b.yaml").write_text("E_3:\n  dataset: \"x: y\"\n")
    got = {r.name: r for r in tables.read_event_config(spark, str(tmp_path / "*.yaml")).collect()}
    assert set(got) == {"E_1", "E_2", "E_3"} and got["E_1"].duration_s == 750 and got["E_1"].station == "ELAN"
    assert got["E_2"].arrow_offset == 3 and got["E_3"].dataset == "x: y"


def test_files_with_several_channels_are_named():
    """A header with more than one channel, or none, is unreadable, as it is for the decoder."""
    import struct

    import pytest

    from brinewave.sources import wav

    mono = wav.encode_pcm16([1, 2, 3, 4], 240)
    for channels in (0, 2):
        fmt = struct.pack("<HIIH", channels, 240, 480 * channels, 2 * channels)
        with pytest.raises(wav.Unreadable):
            wav.walk_header(mono[:22] + fmt + mono[34:])
    assert wav.walk_header(mono)["n_samples"] == 4


def test_missing_vectors_give_no_files(spark):
    """A null is left out by its length; the encoder runs before that filter and must let it pass."""
    from brinewave.plans import views

    rows = spark.createDataFrame([(0, [0.5] * 64), (1, None), (2, [0.25] * 64)], "vec_id long, embedding array<float>")
    assert wav.file_catalog(views.wave_files(rows)).count() == 2
    assert sorted(r.file_start_us - views.WAVE_BASE_US for r in wav.decode_chunks(views.wave_files(rows)).collect()) == [0, 16_000_000]
