"""WAV archives: discovery, catalog and ingest into the chunked waveform table."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from brinewave.functions.timing import parent_name, parse_stamp, samples_duration, stem, to_us
from brinewave.schemas import CHUNKS

CHUNK_S = 100
#: samples of the same file kept behind each chunk
HALO = 4096
#: what a header usually fits in; longer ones are followed to their end
HEADER_BYTES = 4096
MAX_DEPTH = 3
# Format tags
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


class Unreadable(ValueError):
    """A file that is no recording of a known format."""


def walk_header(read: bytes | Callable[[int, int], bytes], length: int | None = None) -> dict:
    """Format fields and the position of the samples of a RIFF file.

    ``read(at, n)`` gives bytes of the file (or pass the bytes themselves): only chunk
    headers are asked for, wherever the samples begin. ``length`` is that of the file: a
    file that ends before its samples do has as many as it holds (``n_samples``), however
    many its header declares (``n_declared``).
    """
    if isinstance(read, bytes):
        data = read
        length = len(data) if length is None else length
        read = lambda at, n: data[at : at + n]
    head = read(0, 12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise Unreadable("not a RIFF/WAVE file")
    at, fmt, tag = 12, None, None
    while len(head := read(at, 8)) == 8:
        name, size = head[:4], struct.unpack_from("<I", head, 4)[0]
        if name == b"fmt ":
            body = read(at + 8, min(size, 40))
            if len(body) < 16:
                raise Unreadable("format chunk is cut")
            fmt = struct.unpack_from("<HHIIHH", body)
            tag = struct.unpack_from("<H", body, 24)[0] if fmt[0] == EXTENSIBLE and len(body) >= 26 else fmt[0]
        elif name == b"data":
            if fmt is None:
                raise Unreadable("samples before the format")
            _, channels, fs, _, align, bits = fmt
            if (tag, bits) not in _FORMATS or not fs or align != channels * bits // 8:
                raise Unreadable(f"format {tag} with {bits} bits")
            if channels != 1:
                raise Unreadable(f"{channels} channels, expected one")
            held = size if length is None else min(size, length - at - 8)
            if held < align:
                raise Unreadable("no samples")
            return {
                "fs": fs,
                "channels": channels,
                "bits": bits,
                "align": align,
                "tag": tag,
                "first_byte": at + 8,
                "n_samples": held // align,
                "n_declared": size // align,
            }
        at += 8 + size + (size & 1)
    raise Unreadable("no data chunk")


# readable formats: 24-bit values take the upper bytes of 32, as PCM readers deliver them
_FORMATS = {(PCM, 8): "u1", (PCM, 16): "<i2", (PCM, 24): None, (PCM, 32): "<i4", (FLOAT, 32): "<f4", (FLOAT, 64): "<f8"}


def decode_pcm(data: bytes) -> tuple[int, int, np.ndarray]:
    """(fs, bits, samples) of a mono file of integers or floats."""
    h = walk_header(data)
    return h["fs"], h["bits"], pcm_samples(data[h["first_byte"] : h["first_byte"] + h["n_samples"] * h["align"]], h)


def pcm_samples(body: bytes, h: dict) -> np.ndarray:
    """Samples of a piece of the data chunk; ``h`` are the fields of ``walk_header``."""
    if h["bits"] == 24:
        raw = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.uint32)
        return ((raw[:, 0] << 8) | (raw[:, 1] << 16) | (raw[:, 2] << 24)).view(np.int32)
    return np.frombuffer(body, _FORMATS[h["tag"], h["bits"]])


# Decoder per file extension: bytes -> (fs, bits, samples)
DECODERS: dict[str, Callable[[bytes], tuple[int, int, np.ndarray]]] = {"wav": decode_pcm}


def register_decoder(extension: str, decode: Callable[[bytes], tuple[int, int, np.ndarray]]) -> None:
    DECODERS[extension] = decode


def list_files(spark: SparkSession, root: str, extension: str = "wav") -> DataFrame:
    """Binary-file scan below ``root``; select ``path, length`` only to skip the payload."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*.{extension}")
        .load(root)
    )


def discover_stations(files: DataFrame, root: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Directories that hold files, at most ``max_depth`` below root.

    Below a directory that holds files nothing further is looked at.
    """
    base = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]+:(//[^/]*)?(?=/)", "", root).rstrip("/")
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    relative = F.regexp_extract("folder", rf"^.*?\Q{base}\E/?(.*)$", 1)
    found = (
        files.select(folder.alias("folder"))
        .distinct()
        .withColumn("parts", F.filter(F.split(relative, "/"), lambda p: p != ""))
    )
    near = found.where(F.size("parts") <= max_depth)
    above = near.select(
        "folder",
        F.explode(F.sequence(F.lit(0), F.size("parts"))).alias("n"),
        "parts",
    ).where(F.col("n") < F.size("parts"))
    tree = F.array_join(F.slice("parts", F.lit(1), F.col("n")), "/")
    shadowed = (
        above.select("folder", tree.alias("tree"))
        .join(near.select(F.array_join("parts", "/").alias("tree")), "tree")
        .select("folder")
    )
    return near.join(shadowed, "folder", "left_anti").select(
        F.element_at(F.split("folder", "/"), -1).alias("station"), F.col("folder").alias("path")
    )


_HEADER = "struct<fs:int,bits:int,n_samples:bigint,n_declared:bigint,reason:string>"
_KINDS = {"fs": pa.int32(), "bits": pa.int32(), "n_samples": pa.int64(), "n_declared": pa.int64(), "reason": pa.string()}


def _header_row(read: Callable[[int, int], bytes] | bytes, length: int) -> dict:
    try:
        h = walk_header(read, length)
        return {c: h.get(c) for c in _KINDS}
    except Unreadable as error:
        return {"reason": str(error)}


def header_fields(heads: Column, length: Column) -> Column:
    """STRUCT<fs, bits, n_samples, n_declared, reason> from the start and the length of each file; null for null."""

    @arrow_udf(_HEADER)
    def run(column: pa.Array, lengths: pa.Array) -> pa.Array:
        rows = zip(column.to_pylist(), lengths.to_pylist())
        return pa.array([None if c is None else _header_row(c, n) for c, n in rows], pa.struct(list(_KINDS.items())))

    # not deterministic to the optimizer: several columns read the result of one call
    return run.asNondeterministic()(heads, length)


def open_path(path: str) -> pa.NativeFile:
    """A file by the name a file scan gives it: scheme and path, in which blanks, ``%`` and ``#`` are plain characters."""
    scheme, place, name = re.match(r"(?:([A-Za-z][A-Za-z0-9+.-]+):)?(//[^/]*)?(.*)", path, re.S).groups()
    if scheme in (None, "file"):
        return fs.LocalFileSystem().open_input_file(name)
    store, base = fs.FileSystem.from_uri(f"{scheme}:{place or '//'}/")
    return store.open_input_file(base.rstrip("/") + name)


def reader_of(file: pa.NativeFile, length: int) -> Callable[[int, int], bytes]:
    return lambda at, n: file.read_at(min(n, max(0, length - at)), at) if at < length else b""


def headers(files: DataFrame) -> DataFrame:
    """``(path, h)`` of all non-empty files.

    With a ``content`` column, the first bytes go to Python, and a whole file only if they
    do not reach its samples. Without one, the files are opened by path and only chunk
    headers are read, so the archive's payload stays where it is.
    """
    files = files.where("length > 0")
    if "content" in files.columns:
        size = F.octet_length("content").cast("bigint")
        short = files.select("path", "content", header_fields(F.substring("content", 1, HEADER_BYTES), size).alias("h"))
        unreached = F.col("h.reason").isin("no data chunk", "format chunk is cut")
        whole = short.withColumn("w", header_fields(F.when(unreached, F.col("content")), size))
        return whole.select("path", F.coalesce("w", "h").alias("h"))

    @arrow_udf(_HEADER)
    def run(paths: pa.Array) -> pa.Array:
        rows = []
        for path in paths.to_pylist():
            with open_path(path) as file:
                rows.append(_header_row(reader_of(file, file.size()), file.size()))
        return pa.array(rows, pa.struct(list(_KINDS.items())))

    return files.select("path", run.asNondeterministic()(F.col("path")).alias("h"))


def file_catalog(files: DataFrame) -> DataFrame:
    """``(station, path, start_us, end_us, fs, bits, n_samples)`` of all readable non-empty files."""
    heads = headers(files).where("h.reason IS NULL")
    start = to_us(parse_stamp(stem("path")))
    return heads.select(
        parent_name("path").alias("station"),
        "path",
        start.alias("start_us"),
        (start + samples_duration("h.n_samples", "h.fs")).alias("end_us"),
        F.col("h.fs").alias("fs"),
        F.col("h.bits").alias("bits"),
        F.col("h.n_samples").alias("n_samples"),
    )


def unreadable_files(files: DataFrame) -> DataFrame:
    """``(path, reason)`` of the files that ``file_catalog`` and ``decode_chunks`` leave out."""
    return headers(files).where("h.reason IS NOT NULL").select("path", "h.reason")


def cut_files(files: DataFrame) -> DataFrame:
    """``(path, n_samples, n_declared)`` of the files that end before their samples do; catalog and chunks hold what is there."""
    found = headers(files).select("path", "h.n_samples", "h.n_declared")
    return found.where("n_samples < n_declared")


def decode_chunks(files: DataFrame, extension: str = "wav", chunk_s: float = CHUNK_S, halo: int = HALO) -> DataFrame:
    """Waveform table from a binary-file scan: one row per ``chunk_s`` seconds of a file.

    Unreadable files give no rows; ``unreadable_files`` names them.
    """
    decode = DECODERS[extension]
    named = files.where("length > 0").select(
        parent_name("path").alias("station"),
        to_us(parse_stamp(stem("path"))).alias("start_us"),
        "content",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for station, start, content in zip(*(batch.column(i) for i in range(3))):
                try:
                    fs, bits, x = decode(content.as_py())
                except Unreadable:
                    continue
                size = chunk_samples(fs, chunk_s)
                first = np.arange(0, len(x), size)
                if len(first):
                    yield chunk_batch(station.as_py(), start.as_py(), fs, bits, len(x), size, first, x.astype(np.float64), 0, halo)

    return named.mapInArrow(run, CHUNKS)


def chunk_samples(fs: int, chunk_s: float) -> int:
    return max(1, int(fs * min(chunk_s, 86_400)))


_CHUNK_FIELDS = pa.schema(
    [
        ("station", pa.string()),
        ("file_start_us", pa.int64()),
        ("file_samples", pa.int64()),
        ("first_sample", pa.int64()),
        ("chunk_us", pa.int64()),
        ("fs", pa.int32()),
        ("bits", pa.int32()),
        ("samples", pa.list_(pa.float64())),
        ("halo", pa.list_(pa.float64())),
    ]
)


def chunk_batch(station: str, start: int, fs: int, bits: int, total: int, size: int, first: np.ndarray, x: np.ndarray, at: int, halo: int) -> pa.RecordBatch:
    """Rows of the chunks that begin at samples ``first``; ``x`` are the file's samples from number ``at``, halo included."""
    n = len(first)
    ends = np.minimum(first + size, total)
    offsets = (np.append(first, ends[-1]) - at).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([station] * n, pa.string()),
            pa.array([start] * n, pa.int64()),
            pa.array(np.full(n, total), pa.int64()),
            pa.array(first, pa.int64()),
            pa.array([None if start is None else start + us for us in np.rint(first * 1e6 / fs).astype(np.int64).tolist()], pa.int64()),
            pa.array(np.full(n, fs), pa.int32()),
            pa.array(np.full(n, bits), pa.int32()),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)),
            pa.array([x[end - at : end - at + halo] for end in ends], pa.list_(pa.float64())),
        ],
        schema=_CHUNK_FIELDS,
    )


def encode_wav(samples, fs: int, bits: int = 16, tag: int = PCM, before: bytes = b"") -> bytes:
    """Mono file of the given values; ``before`` stands in a LIST chunk in front of them."""
    if bits == 24:
        body = np.asarray(samples, dtype="<i4").reshape(-1, 1).view(np.uint8)[:, :3].tobytes()
    else:
        body = np.asarray(samples).astype(_FORMATS[tag, bits]).tobytes()
    width = bits // 8
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, tag, 1, fs, width * fs, width, bits)
    extra = struct.pack("<4sI", b"LIST", len(before)) + before + b"\0" * (len(before) & 1) if before else b""
    chunks = fmt + extra + struct.pack("<4sI", b"data", len(body)) + body + b"\0" * (len(body) & 1)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(chunks), b"WAVE") + chunks


def encode_pcm16(samples: list, fs: int) -> bytes:
    """Mono 16-bit WAV file of the given integers."""
    return encode_wav(samples, fs)


def encoded(samples: str, fs: int, kinds: list[dict] | None = None, kind: Column | None = None):
    """Binary column with the WAV file of an array column, null for null; ``kind`` chooses from ``encode_wav`` options."""
    kinds = kinds or [{}]

    @arrow_udf("binary")
    def run(s: pa.Array, k: pa.Array) -> pa.Array:
        return pa.array([encode_wav(row.as_py(), fs, **kinds[i.as_py()]) if row.is_valid else None for row, i in zip(s, k)], pa.binary())

    # not deterministic to the optimizer: filters and later columns read the file of one call
    return run.asNondeterministic()(F.col(samples), F.lit(0) if kind is None else kind)
