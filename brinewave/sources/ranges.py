"""Recordings read by byte ranges: a long file is many tasks, and no task holds a whole one.

A range owns the chunks whose first byte lies inside it. Its task reads the header, then the
bytes of its chunks and the halo behind the last one, a few chunks at a time. Two forms
share this: ``decode_ranges`` deals out ranges of a file scan as rows, and ``RecordingSource``
is a data source (``spark.read.format("recordings")``) whose partitions are the ranges and
which skips stations and times that the query's filters exclude.

Paths are opened by pyarrow (local, HDFS, S3, GCS); a store that only Spark's own readers
reach is decoded from whole files instead (``wav.decode_chunks``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from brinewave.functions.timing import parent_name, parse_stamp, stem, to_us
from brinewave.schemas import CHUNKS
from brinewave.sources import wav

RANGE_BYTES = 64 << 20
#: bytes of samples that a task holds at a time
READ_BYTES = 8 << 20


@dataclass(frozen=True)
class Decoder:
    """How a kind of recording is read: ``header(read, length)`` and ``samples(body, header)``.

    The header names fs, bits, n_samples, first_byte and align, the bytes of a sample; it
    raises ``wav.Unreadable`` for a file that is none.
    """

    header: Callable[[Callable[[int, int], bytes], int], dict]
    samples: Callable[[bytes, dict], np.ndarray]


DECODERS: dict[str, Decoder] = {"wav": Decoder(wav.walk_header, wav.pcm_samples)}


def register_decoder(extension: str, decoder: Decoder) -> None:
    """Read files of another extension by ranges too."""
    DECODERS[extension] = decoder


def read_range(
    path: str, station: str, start_us: int | None, begin: int, end: int, decoder: Decoder, chunk_s: float, halo: int,
    wanted: Callable[[np.ndarray], np.ndarray] | None = None,
) -> Iterator[pa.RecordBatch]:
    """Chunk rows whose first byte lies in ``begin .. end``; ``wanted`` picks among their start times."""
    with wav.open_path(path) as file:
        length = file.size()
        try:
            h = decoder.header(wav.reader_of(file, length), length)
        except wav.Unreadable:
            return
        size = wav.chunk_samples(h["fs"], chunk_s)
        step = size * h["align"]
        first = np.arange(max(0, -(-(begin - h["first_byte"]) // step)), -(-(end - h["first_byte"]) // step), dtype=np.int64) * size
        first = first[first < h["n_samples"]]
        if wanted is not None and start_us is not None:
            first = first[wanted(start_us + np.rint(first * 1e6 / h["fs"]).astype(np.int64))]
        at_once = max(1, READ_BYTES // step)
        # neighbours are read together
        for run in np.split(first, np.flatnonzero(np.diff(first) != size) + 1):
            for k in range(0, len(run), at_once):
                part = run[k : k + at_once]
                stop = min(int(part[-1]) + size + halo, h["n_samples"])
                body = file.read_at((stop - int(part[0])) * h["align"], h["first_byte"] + int(part[0]) * h["align"])
                x = decoder.samples(body, h).astype(np.float64)
                yield wav.chunk_batch(station, start_us, h["fs"], h["bits"], h["n_samples"], size, part, x, int(part[0]), halo)


def decode_ranges(
    files: DataFrame, extension: str = "wav", chunk_s: float = wav.CHUNK_S, halo: int = wav.HALO, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Waveform table of ``(path, length)`` rows, as ``wav.decode_chunks`` gives it from whole files.

    The ranges are rows, spread over as many tasks as the archive has ranges.
    """
    decoder = DECODERS[extension]
    files = files.where("length > 0").select("path", "length")
    total = files.agg(F.sum("length").alias("n"), F.count("*").alias("files")).first()
    tasks = max(1, min(100_000, -(-(total["n"] or 0) // range_bytes)))
    pieces = files.select(
        "path",
        parent_name("path").alias("station"),
        to_us(parse_stamp(stem("path"))).alias("start_us"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(range_bytes).cast("bigint"))).alias("begin"),
    ).repartition(tasks, "path", "begin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from read_range(row["path"], row["station"], row["start_us"], row["begin"], row["begin"] + range_bytes, decoder, chunk_s, halo)

    return pieces.mapInArrow(run, CHUNKS)


@dataclass
class Range(InputPartition):
    path: str
    station: str
    start_us: int | None
    begin: int
    end: int


def start_of(path: str) -> int | None:
    name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    try:
        at = datetime.strptime(name, "%Y%m%d_%H%M%S").replace(tzinfo=timezone.utc)
    except ValueError:
        return None
    return int(at.timestamp()) * 1_000_000


class RecordingReader(DataSourceReader):
    """Lists the files by name and length; filters are kept to skip files and chunks, and Spark applies them again."""

    def __init__(self, options: dict, decoders: dict[str, Decoder] = DECODERS):
        self.root = options["path"]
        self.extension = options.get("extension", "wav")
        self.decoder = decoders[self.extension]
        self.chunk_s = float(options.get("chunkseconds", wav.CHUNK_S))
        self.halo = int(options.get("halo", wav.HALO))
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.stations: set[str] | None = None
        self.low: dict[str, int] = {}
        self.high: dict[str, int] = {}

    def pushFilters(self, filters):
        for f in filters:
            name = getattr(f, "attribute", ("",))[0]
            if name == "station" and isinstance(f, (EqualTo, In)):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.stations = named if self.stations is None else self.stations & named
            if name in ("chunk_us", "file_start_us"):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low[name] = max(f.value, self.low.get(name, f.value))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high[name] = min(f.value, self.high.get(name, f.value))
            yield f

    def files(self) -> list[tuple[str, int]]:
        """(path, length) of the files below the root, from the listing alone."""
        prefix, store, name = "", fs.LocalFileSystem(), self.root
        if ":" in self.root.split("/", 1)[0]:
            scheme, rest = self.root.split(":", 1)
            name = "/" + rest.lstrip("/") if scheme == "file" else rest
            if scheme != "file":
                place, _, name = rest[2:].partition("/")
                store, base = fs.FileSystem.from_uri(f"{scheme}://{place}/")
                prefix, name = f"{scheme}://{place}", f"{base.rstrip('/')}/{name}"
        found = store.get_file_info(fs.FileSelector(name, recursive=True))
        return sorted((prefix + i.path, i.size) for i in found if i.is_file and i.path.endswith(f".{self.extension}") and i.size > 0)

    def skipped(self, station: str, start_us: int | None) -> bool:
        if self.stations is not None and station not in self.stations:
            return True
        if start_us is None:
            return False
        # a file says by its name when it begins, not when it ends
        return (
            start_us > min(self.high.get("chunk_us", start_us), self.high.get("file_start_us", start_us))
            or start_us < self.low.get("file_start_us", start_us)
        )

    def partitions(self) -> list[Range]:
        out = []
        for path, length in self.files():
            station, start_us = path.split("/")[-2], start_of(path)
            if not self.skipped(station, start_us):
                out += [Range(path, station, start_us, b, b + self.range_bytes) for b in range(0, length, self.range_bytes)]
        return out

    def wanted(self, chunk_us: np.ndarray) -> np.ndarray:
        low, high = self.low.get("chunk_us"), self.high.get("chunk_us")
        return (chunk_us >= (chunk_us if low is None else low)) & (chunk_us <= (chunk_us if high is None else high))

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        p = partition
        if p is None:  # no file at all
            return
        yield from read_range(p.path, p.station, p.start_us, p.begin, p.end, self.decoder, self.chunk_s, self.halo, self.wanted)


class RecordingSource(DataSource):
    """Options: path, extension, chunkSeconds, halo, rangeBytes."""

    decoders = DECODERS

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return CHUNKS

    def reader(self, schema) -> RecordingReader:
        return RecordingReader({k.lower(): v for k, v in self.options.items()}, self.decoders)


def read_recordings(spark: SparkSession, root: str, **options) -> DataFrame:
    """Waveform table of an archive, lazily: filters on station and times keep files and chunks from being read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    # a class of its own takes the decoders registered here along to the workers
    spark.dataSource.register(type("Recordings", (RecordingSource,), {"decoders": dict(DECODERS)}))
    return spark.read.format("recordings").options(**options).load(root)
