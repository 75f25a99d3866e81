"""Matroska media in binary columns: packet tables, and a writer for 8-bit samples.

``parse`` walks the EBML elements of a file: variable-length ids and sizes, masters of
unknown size, clusters with simple blocks and block groups, all four kinds of lacing, and
cues. ``packets`` turns a media column into one row per packet with track, timestamp and
byte range, so payloads can be cut from the file without reading it again.

Defined cases: null and empty media have no packets; a damaged or cut file gives the packets
before the damage and says so in ``error``; equal files give equal rows; unknown elements
are skipped; other columns pass through, and packet columns that would clash get a prefix.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from brinewave.llm.common import fresh, llm_query, schema_with, slices, table

# fixed values: element ids of the format
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x2AD7B1, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, RATE, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
MUXING_APP, WRITING_APP, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x4D80, 0x5741, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
#: what ends a cluster of unknown size
_TOP = {CLUSTER, CUES, INFO, TRACKS, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS, SEGMENT, EBML}

#: written files: 8 kHz, packets of 192 samples (24 ms), eight to a block, 64 blocks to a cluster
SAMPLE_RATE, PACKET, LACE, CLUSTER_BLOCKS = 8000, 192, 8, 64
PACKET_NS = PACKET * 1_000_000_000 // SAMPLE_RATE


class Damaged(ValueError):
    pass


def vint(data: bytes, at: int) -> tuple[int, int]:
    """An id with its marker, and the position after it."""
    first = data[at]
    if not first:
        raise Damaged(f"no length marker at {at}")
    n = 9 - first.bit_length()
    if at + n > len(data):
        raise Damaged(f"cut at {at}")
    return int.from_bytes(data[at : at + n], "big"), at + n


def size_at(data: bytes, at: int) -> tuple[int | None, int]:
    """A size without its marker (None: unknown), and the position after it."""
    value, after = vint(data, at)
    bits = 7 * (after - at)
    value &= (1 << bits) - 1
    return (None if value == (1 << bits) - 1 else value), after


@dataclass
class Media:
    scale: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    #: (track, timestamp in ns, first byte, size, keyframe, cluster number)
    packets: list[tuple[int, int, int, int, bool, int]] = field(default_factory=list)
    #: (timestamp in ns, track, position of the cluster in the file)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    error: str | None = None

    def seek(self, ns: int) -> int | None:
        """Position of the cluster of the last cue at or before a time."""
        return max(((t, at) for t, _, at in self.cues if t <= ns), default=(0, None))[1]


def _children(data: bytes, at: int, end: int, inside: int | None = None) -> Iterator[tuple[int, int, int]]:
    """``(id, first byte, end)`` of the elements of a master; ``inside`` is a cluster of unknown size."""
    while at < end:
        element, body = vint(data, at)
        if inside is not None and element in _TOP:
            return
        size, body = size_at(data, body)
        stop = end if size is None else body + size
        if size is None and element not in (SEGMENT, CLUSTER):
            raise Damaged(f"unknown size of {element:X} at {at}")
        if size is None and element == CLUSTER:
            stop = _cluster_end(data, body, end)
        if stop > end:
            if element not in (SEGMENT, CLUSTER):
                raise Damaged(f"{element:X} at {at} is cut")
            yield element, body, end
            raise Damaged(f"{element:X} at {at} is cut")
        yield element, body, stop
        at = stop


def _cluster_end(data: bytes, at: int, end: int) -> int:
    while at < end:
        element, body = vint(data, at)
        if element in _TOP:
            return at
        size, body = size_at(data, body)
        if size is None or body + size > end:
            return end
        at = body + size
    return end


def _uint(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _lace_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """Sizes of the frames of a laced block, and where the first one begins."""
    if kind == 0:
        return [end - at], at
    count = data[at] + 1
    at += 1
    sizes: list[int] = []
    if kind == 2:
        each, rest = divmod(end - at, count)
        if rest:
            raise Damaged(f"uneven lace at {at}")
        return [each] * count, at
    for k in range(count - 1):
        if kind == 1:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            value, after = size_at(data, at)
            if value is None:
                raise Damaged(f"lace size at {at}")
            size = value if k == 0 else sizes[-1] + value - ((1 << (7 * (after - at) - 1)) - 1)
            at = after
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Damaged(f"lace at {at} is longer than its block")
    return sizes, at


def _block(media: Media, data: bytes, at: int, end: int, base: int, simple: bool) -> None:
    track, at = size_at(data, at)
    if track is None or at + 3 > end:
        raise Damaged(f"block at {at}")
    shift = int.from_bytes(data[at : at + 2], "big", signed=True)
    flags = data[at + 2]
    sizes, at = _lace_sizes(data, at + 3, end, (flags >> 1) & 3)
    time, step = (base + shift) * media.scale, media.tracks.get(track, {}).get("duration", 0)
    key, cluster = bool(flags & 0x80) or not simple, len(media.clusters) - 1
    for k, size in enumerate(sizes):
        media.packets.append((track, time + k * step, at, size, key, cluster))
        at += size


def _float(data: bytes, a: int, b: int) -> float:
    return float(np.frombuffer(data[a:b], f">f{b - a}")[0]) if b - a in (4, 8) else 0.0


def _segment(media: Media, data: bytes, at: int, end: int) -> None:
    start = at
    for element, a, b in _children(data, at, end):
        if element == INFO:
            media.scale = next((_uint(data, x, y) for e, x, y in _children(data, a, b) if e == TIMESTAMP_SCALE), media.scale)
        elif element == TRACKS:
            for entry, x, y in _children(data, a, b):
                if entry == TRACK_ENTRY:
                    parts = {e: (p, q) for e, p, q in _children(data, x, y)}
                    audio = {e: (p, q) for e, p, q in _children(data, *parts[AUDIO])} if AUDIO in parts else {}
                    number = _uint(data, *parts[TRACK_NUMBER]) if TRACK_NUMBER in parts else 0
                    media.tracks[number] = {
                        "codec": data[slice(*parts[CODEC_ID])].decode("ascii", "replace") if CODEC_ID in parts else "",
                        "duration": _uint(data, *parts[DEFAULT_DURATION]) if DEFAULT_DURATION in parts else 0,
                        "rate": _float(data, *audio[RATE]) if RATE in audio else 8000.0,
                        "bits": _uint(data, *audio[BIT_DEPTH]) if BIT_DEPTH in audio else 0,
                    }
        elif element == CLUSTER:
            base = 0
            media.clusters.append(a)
            for e, x, y in _children(data, a, b):
                if e == TIMESTAMP:
                    base = _uint(data, x, y)
                elif e == SIMPLE_BLOCK:
                    _block(media, data, x, y, base, True)
                elif e == BLOCK_GROUP:
                    for f, p, q in _children(data, x, y):
                        if f == BLOCK:
                            _block(media, data, p, q, base, False)
        elif element == CUES:
            for e, x, y in _children(data, a, b):
                if e == CUE_POINT:
                    parts = list(_children(data, x, y))
                    time = next((_uint(data, p, q) for f, p, q in parts if f == CUE_TIME), 0)
                    for f, p, q in parts:
                        if f == CUE_POSITIONS:
                            where = {g: _uint(data, r, s) for g, r, s in _children(data, p, q)}
                            media.cues.append((time * media.scale, where.get(CUE_TRACK, 0), start + where.get(CUE_CLUSTER, 0)))


def parse(data: bytes | None) -> Media:
    """Tracks, packets and cues of a file."""
    media = Media()
    try:
        for element, a, b in _children(data or b"", 0, len(data or b"")):
            if element == SEGMENT:
                _segment(media, data, a, b)
    except (Damaged, IndexError) as error:
        media.error = str(error)
    return media


def _element(element: int, body: bytes, width: int | None = None) -> bytes:
    n = width or next(k for k in range(1, 9) if len(body) < (1 << 7 * k) - 1)
    return element.to_bytes((element.bit_length() + 7) // 8, "big") + (len(body) | 1 << 7 * n).to_bytes(n, "big") + body


def _number(element: int, value: int) -> bytes:
    return _element(element, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


_HEAD = _element(EBML, _element(DOC_TYPE, b"matroska") + _number(DOC_TYPE_VERSION, 4) + _number(DOC_TYPE_READ_VERSION, 2))
_INFO = _element(INFO, _number(TIMESTAMP_SCALE, 1_000_000) + _element(MUXING_APP, b"brinewave") + _element(WRITING_APP, b"brinewave"))
_AUDIO = _element(AUDIO, _element(RATE, np.array(SAMPLE_RATE, ">f8").tobytes()) + _number(CHANNELS, 1) + _number(BIT_DEPTH, 8))
_TRACK = _number(TRACK_NUMBER, 1) + _number(TRACK_UID, 1) + _number(TRACK_TYPE, 2) + _element(CODEC_ID, b"A_PCM/INT/LIT")
_TRACKS = _element(TRACKS, _element(TRACK_ENTRY, _TRACK + _number(DEFAULT_DURATION, PACKET_NS) + _AUDIO))


def _laced(frames: int, kind: int) -> bytes:
    """Lace header of equal frames: none, Xiph, fixed or EBML."""
    if frames == 1:
        return b""
    if kind == 1:
        return bytes([frames - 1]) + bytes([PACKET] * (frames - 1))
    if kind == 2:
        return bytes([frames - 1])
    return bytes([frames - 1]) + (PACKET | 0x4000).to_bytes(2, "big") + bytes([0x80 | 63] * (frames - 2))


def write_samples(samples: bytes) -> bytes:
    """A file of one track of 8-bit samples, a multiple of ``PACKET`` of them; lacing kinds take turns."""
    per_block, per_cluster = PACKET * LACE, PACKET * LACE * CLUSTER_BLOCKS
    parts, cues = [_INFO, _TRACKS], []
    position = len(_INFO) + len(_TRACKS)
    for first in range(0, len(samples), per_cluster):
        time = first // PACKET * (PACKET * 1000 // SAMPLE_RATE)
        body = [_number(TIMESTAMP, time)]
        for k, at in enumerate(range(first, min(first + per_cluster, len(samples)), per_block)):
            block = samples[at : at + per_block]
            frames, kind = len(block) // PACKET, 1 + k % 3
            shift = (at - first) // PACKET * (PACKET * 1000 // SAMPLE_RATE)
            head = b"\x81" + shift.to_bytes(2, "big") + bytes([0x80 | (kind << 1 if frames > 1 else 0)])
            body.append(_element(SIMPLE_BLOCK, head + _laced(frames, kind) + block))
        cluster = _element(CLUSTER, b"".join(body))
        cues.append(_element(CUE_POINT, _number(CUE_TIME, time) + _element(CUE_POSITIONS, _number(CUE_TRACK, 1) + _number(CUE_CLUSTER, position))))
        parts.append(cluster)
        position += len(cluster)
    parts.append(_element(CUES, b"".join(cues)))
    return _HEAD + _element(SEGMENT, b"".join(parts), 8)


def padded_text(text: str | None) -> bytes:
    """UTF-8 bytes, filled with blanks up to a positive multiple of ``PACKET``."""
    data = (text or "").encode()
    return data.ljust(max(1, -(-len(data) // PACKET)) * PACKET)


def write_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``docs`` with each text stored as a media file, and its unpadded size, in place of the text."""
    at = docs.columns.index(text)
    kept = docs.select(*(c for c in docs.columns if c != text))
    size = fresh(kept, "n_bytes")
    schema = schema_with(kept, **{size: "long", media: "binary"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 1 << 22):
            texts = batch.column(at).to_pylist()
            files = [write_samples(padded_text(t)) for t in texts]
            sizes = [len((t or "").encode()) for t in texts]
            rest = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], schema.names)

    return docs.mapInArrow(run, schema)


def packets(df: DataFrame, media: str = "media") -> DataFrame:
    """One row per packet, with the other columns of ``df`` and a damaged file's ``error``.

    A file without packets has one row of nulls.
    """
    at = df.columns.index(media)
    kept = df.select(*(c for c in df.columns if c != media))
    kinds = {"track": "long", "timestamp_ns": "long", "first_byte": "long", "n_bytes": "long", "keyframe": "boolean", "cluster": "long", "error": "string"}
    schema = schema_with(kept, **{fresh(kept, k): kind for k, kind in kinds.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, media, 1 << 20):
            owner, rows = [], []
            for i, data in enumerate(batch.column(at)):
                found = parse(data.as_py())
                owner += [i] * max(1, len(found.packets))
                rows += [(*p, found.error) for p in found.packets] or [(None,) * 6 + (found.error,)]
            rest = [batch.column(i).take(pa.array(owner, pa.int64())) for i in range(batch.num_columns) if i != at]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string()]
            made = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*rest, *made], schema.names)

    return df.mapInArrow(run, schema)


def features(media: Media, payload: bytes) -> str:
    """Counts of the container, and level and zero crossings of the samples around 128."""
    x = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    last = max((p[1] for p in media.packets), default=0) // 1_000_000
    mean = int(x.sum(dtype=np.int64)) / max(1, len(x))
    return (
        f"tracks={len(media.tracks)};clusters={len(media.clusters)};packets={len(media.packets)};cues={len(media.cues)};"
        f"last_ms={last};mean={mean:.4f};crossings={crossings}"
    )


def media_digest(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with digests of the payload read back by its packets' byte ranges, in place of the media."""
    at = df.columns.index(media)
    kept = df.select(*(c for c in df.columns if c != media))
    kinds = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}
    schema = schema_with(kept, **{fresh(kept, k): kind for k, kind in kinds.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, media, 1 << 22):
            rows = []
            for value in batch.column(at):
                data = value.as_py() or b""
                found = parse(data)
                payload = b"".join([data[p[2] : p[2] + p[3]] for p in found.packets])
                rows.append(
                    (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), features(found, payload))
                )
            rest = [batch.column(i) for i in range(batch.num_columns) if i != at]
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*rest, *(pa.array(c, t) for c, t in zip(zip(*rows), types))], schema.names)

    return df.mapInArrow(run, schema)


@llm_query("op1_matroska_packets")
def op1(spark, sf_dir):
    """Every document stored as 8-bit samples in a Matroska file and read back through its packets."""
    return media_digest(write_media(table(spark, sf_dir, "documents").select("doc_id", "text")))
