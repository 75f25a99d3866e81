"""Recordings by byte ranges against whole files, and damaged ones."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinewave.plans import dataset_build
from brinewave.sources import ranges, sinks, wav

S = 1_000_000
START = 1577836800 * S  # 2020-01-01


def rows_of(chunks):
    return sorted((r.station, r.file_start_us, r.first_sample, r.file_samples, r.chunk_us, r.fs, r.bits, tuple(r.samples), tuple(r.halo)) for r in chunks.collect())


@pytest.fixture()
def odd(tmp_path):
    """Odd folder names, all widths, a long header, and files that are cut, empty or no recordings."""
    rng = np.random.default_rng(1)
    root = tmp_path / "my archive %41#1"

    def put(name, data):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)

    put("A b/20200101_000000.wav", wav.encode_wav(rng.integers(-9, 9, 5000), 100))
    put("C%20d/20200101_000000.wav", wav.encode_wav(rng.integers(-9, 9, 777), 10, 24, before=b"x" * 5001))
    put("E#f/20200101_000000.wav", wav.encode_wav(rng.normal(size=900), 7, 32, wav.FLOAT))
    put("E#f/20200101_001000.wav", wav.encode_wav(rng.integers(0, 255, 300), 9, 8))
    put("E#f/20200101_002000.wav", wav.encode_wav(range(400), 8)[: 44 + 2 * 150 + 1])
    put("E#f/20200101_003000.wav", b"RIFF0000WAVE")
    put("E#f/20200101_004000.wav", wav.encode_wav(range(8), 8)[:44])
    put("E#f/20200101_005000.wav", b"")
    put("E#f/20200101_010000.wav", wav.encode_wav([1, 2], 8, 16)[:30])
    put("E#f/notes.txt", b"none")
    return str(root)


@pytest.mark.parametrize("range_bytes", [97, 1000, 1 << 20])
@pytest.mark.parametrize("chunk_s", [3, 100])
def test_ranges_equal_whole_files(spark, odd, range_bytes, chunk_s):
    files = wav.list_files(spark, odd)
    want = rows_of(wav.decode_chunks(files, chunk_s=chunk_s, halo=20))
    assert len(want) > 5
    assert rows_of(ranges.decode_ranges(files, chunk_s=chunk_s, halo=20, range_bytes=range_bytes)) == want
    assert rows_of(ranges.read_recordings(spark, odd, rangeBytes=range_bytes, chunkSeconds=chunk_s, halo=20)) == want


def test_a_range_is_read_piece_by_piece(spark, odd, monkeypatch):
    monkeypatch.setattr(ranges, "READ_BYTES", 64)
    path = f"{odd}/A b/20200101_000000.wav"
    got = list(ranges.read_range(path, "A b", 0, 0, 1 << 20, ranges.DECODERS["wav"], 1, 5))
    assert len(got) == 50 and sum(len(b["samples"][0].as_py()) for b in got) == 5000


def test_long_files_are_several_partitions(odd):
    reader = ranges.RecordingReader({"path": odd, "rangebytes": "1000"})
    parts = [p for p in reader.partitions() if p.station == "A b"]
    assert len(parts) == 11 and parts[0].start_us == START
    assert ranges.start_of("x/y.wav") is None
    assert [s for _, s in reader.files()] and all("notes" not in p for p, _ in reader.files())


def test_filters_skip_files_and_chunks(spark, odd, monkeypatch):
    chunks = ranges.read_recordings(spark, odd, rangeBytes=1000, chunkSeconds=10)
    some = chunks.where((F.col("station") == "A b") & (F.col("chunk_us") >= START + 10 * S) & (F.col("chunk_us") < START + 30 * S))
    assert [r.chunk_us for r in some.orderBy("chunk_us").collect()] == [START + 10 * S, START + 20 * S]
    assert chunks.where(F.col("station").isin("E#f", "none") & (F.col("file_start_us") > START)).select("file_start_us").distinct().count() == 2
    assert "station" in some._jdf.queryExecution().executedPlan().toString()
    reader = ranges.RecordingReader({"path": odd})
    kept = [ranges.EqualTo(("station",), "E#f"), ranges.LessThan(("chunk_us",), START + 700 * S)]
    assert list(reader.pushFilters(kept)) == kept
    assert {(p.station, p.start_us) for p in reader.partitions()} == {("E#f", START), ("E#f", START + 600 * S)}
    assert reader.wanted(np.array([START, START + 800 * S])).tolist() == [True, False]


def test_catalog_chunks_and_problems_agree(spark, odd):
    by_path, by_content = wav.list_files(spark, odd).select("path", "length"), wav.list_files(spark, odd)
    for files in (by_path, by_content):
        held = {(r.station, r.start_us): r.n_samples for r in wav.file_catalog(files).collect()}
        chunks = ranges.decode_ranges(files, chunk_s=5)
        assert held == {(r.station, r.file_start_us): r.n for r in chunks.groupBy("station", "file_start_us").agg(F.sum(F.size("samples")).alias("n")).collect()}
        assert held[("E#f", START + 1200 * S)] == 150 and len(held) == 5
        assert {(r.path[-19:-4], r.n_samples, r.n_declared) for r in wav.cut_files(files).collect()} == {("20200101_002000", 150, 400)}
        bad = {r.path[-19:-4]: r.reason for r in wav.unreadable_files(files).collect()}
        assert bad == {"20200101_003000": "no data chunk", "20200101_004000": "no samples", "20200101_010000": "format chunk is cut"}


def test_ingest_names_problems_once(spark, odd, tmp_path):
    table = str(tmp_path / "t")
    for _ in range(2):
        dataset_build.ingest(spark, odd, table)
    chunks = spark.read.parquet(table)
    assert chunks.agg(F.sum(F.size("samples"))).first()[0] == 5000 + 777 + 900 + 300 + 150
    problems = spark.read.parquet(f"{table}_problems").select("path", "reason").distinct().collect()
    assert sorted(r.reason for r in problems) == ["cut: 150 of 400 samples", "format chunk is cut", "no data chunk", "no samples"]
    whole = str(tmp_path / "w")
    dataset_build.ingest(spark, odd, whole, by_range=False)
    assert rows_of(spark.read.parquet(whole).drop("date")) == rows_of(chunks.drop("date"))


def test_another_kind_of_recording(spark, tmp_path):
    """Files of 4-byte big-endian values behind their rate."""

    def header(read, length):
        head = read(0, 4)
        if len(head) < 4:
            raise wav.Unreadable("no rate")
        return {"fs": struct.unpack(">i", head)[0], "bits": 32, "n_samples": (length - 4) // 4, "first_byte": 4, "align": 4}

    folder = tmp_path / "S"
    folder.mkdir()
    (folder / "20200101_000000.raw").write_bytes(struct.pack(">i", 10) + np.arange(95, dtype=">i4").tobytes())
    (folder / "20200101_000100.raw").write_bytes(b"x")
    ranges.register_decoder("raw", ranges.Decoder(header, lambda body, h: np.frombuffer(body, ">i4")))
    got = ranges.read_recordings(spark, str(tmp_path), extension="raw", rangeBytes=64, chunkSeconds=3).orderBy("chunk_us").collect()
    assert [len(r.samples) for r in got] == [30, 30, 30, 5] and got[3].samples == [90.0, 91.0, 92.0, 93.0, 94.0]
    table = str(tmp_path / "t")
    dataset_build.ingest(spark, str(tmp_path), table, "raw")
    assert spark.read.parquet(table).count() == 1


def test_empty_archive(spark, tmp_path):
    (tmp_path / "a").mkdir()
    assert ranges.read_recordings(spark, str(tmp_path)).count() == 0
    assert ranges.decode_ranges(wav.list_files(spark, str(tmp_path))).count() == 0


def test_files_are_written_where_named(spark, tmp_path):
    rows = spark.createDataFrame([("a b/x#1.bin", bytearray(b"12")), ("c%20/y", bytearray(b""))], "path string, content binary")
    for root in (f"file://{tmp_path}/one", f"{tmp_path}/two"):
        sinks.write_files(rows, root)
    for name in ("one", "two"):
        assert (tmp_path / name / "a b" / "x#1.bin").read_bytes() == b"12" and (tmp_path / name / "c%20" / "y").exists()
