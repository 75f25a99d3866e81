"""Matroska and WARC: round trips, foreign files, damage, any split size."""

import io
import random

import pytest
from pyspark.sql import functions as F

from brinewave.llm import matroska as m
from brinewave.llm import warc
from brinewave.llm.common import new_folder, prepare


def payload(media, data):
    return b"".join(data[p[2] : p[2] + p[3]] for p in media.packets)


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 8 * 192, 8 * 192 * 64, 300_000])
def test_round_trip(n):
    samples = m.padded_text("é" + "x" * n)
    data = m.write_samples(samples)
    media = m.parse(data)
    assert payload(media, data) == samples and media.error is None
    assert [p[1] for p in media.packets] == [k * m.PACKET_NS for k in range(len(samples) // m.PACKET)]
    assert len(media.cues) == len(media.clusters)
    for (time, track, at), first in zip(media.cues, media.clusters):
        assert track == 1 and int.from_bytes(data[at : at + 4], "big") == m.CLUSTER and at < first
    assert media.seek(10**15) == media.cues[-1][2]


def test_foreign_layouts():
    """Unknown sizes, block groups, uneven laces, unknown and void elements."""
    e = m._element
    xiph = b"\x81\x00\x05\x02" + bytes([2, 255, 45, 10]) + b"a" * 300 + b"b" * 10 + b"c" * 7
    ebml = b"\x81\xff\xfb\x86" + bytes([2, 0x80 | 10]) + (0x4000 | (8191 + 290)).to_bytes(2, "big") + b"d" * 10 + b"e" * 300 + b"f" * 5
    one = b"\x82\x00\x00\x80" + b"g" * 4
    cluster = m._number(m.TIMESTAMP, 100) + e(0xEC, b"\0" * 9) + e(m.BLOCK_GROUP, e(m.BLOCK, xiph)) + e(m.SIMPLE_BLOCK, ebml)
    unknown = b"\x01\xff\xff\xff\xff\xff\xff\xff"
    data = m._HEAD + m.SEGMENT.to_bytes(4, "big") + unknown + e(0x4DBB, b"?") + m._TRACKS
    data += m.CLUSTER.to_bytes(4, "big") + unknown + cluster + e(m.CLUSTER, m._number(m.TIMESTAMP, 200) + e(m.SIMPLE_BLOCK, one))
    media = m.parse(data)
    assert media.error is None
    assert [data[p[2] : p[2] + p[3]] for p in media.packets] == [b"a" * 300, b"b" * 10, b"c" * 7, b"d" * 10, b"e" * 300, b"f" * 5, b"g" * 4]
    step = m.PACKET_NS
    assert [p[1] for p in media.packets] == [105_000_000 + k * step for k in range(3)] + [95_000_000 + k * step for k in range(3)] + [200_000_000]
    assert [p[0] for p in media.packets] == [1] * 6 + [2] and [p[5] for p in media.packets] == [0] * 6 + [1]


def test_every_cut_is_reported():
    data = m.write_samples(m.padded_text("word " * 900))
    whole = m.parse(data).packets
    for end in range(0, len(data), 97):
        media = m.parse(data[:end])
        assert media.packets == whole[: len(media.packets)]
        assert media.error or not end or len(media.packets) in (0, len(whole))


def test_media_table(spark):
    prepare(spark)
    df = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "x" * 5000)], "doc_id long, text string").withColumn("track", F.lit("mine"))
    stored = m.write_media(df)
    rows = m.media_digest(stored).collect()
    assert [r.n_bytes for r in rows] == [0, 0, 0, 5000] and [r.payload_bytes for r in rows] == [192, 192, 192, 5184]
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in rows[:3]}) == 1
    table = m.packets(stored.union(stored.limit(0)).unionByName(stored.limit(1).withColumn("media", F.lit(b"junk"))))
    assert table.columns[:4] == ["doc_id", "track", "n_bytes", "_track"] and table.where("_track = 1").count() == 3 + 27
    assert table.where("error is not null").count() == 1
    assert m.media_digest(stored.limit(0)).count() == 0


def archive(n=40):
    r = random.Random(n)
    parts = [warc._record(i, f"http://h/{i}", bytes(r.randrange(256) for _ in range(r.randrange(3000))), bytes(20), 1 if i % 7 == 3 else None) for i in range(n)]
    return parts, b"".join(parts)


@pytest.mark.parametrize("step", [1, 50, 999, 5000, 10**7])
def test_every_record_is_owned_once(step):
    parts, data = archive(12)

    class File(io.BytesIO):
        def read_at(self, n, at):
            self.seek(at)
            return self.read(n)

    found = [x for start in range(0, len(data), step) for x in warc.records(File(data), len(data), start, start + step)]
    starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
    assert [o for o, _ in found] == starts
    assert [warc.parse_record(c)["record_id"] for _, c in found] == [f"<urn:page:{i}>" for i in range(12)]


def test_false_magic_gaps_and_cuts():
    parts, _ = archive(5)
    data = b"junk\x1f\x8b\x08junk" + parts[0] + b"\x1f\x8b\x08\0\0\0\0\0" + parts[1] + b"\0" * 99 + parts[2][:-20]

    class File(io.BytesIO):
        def read_at(self, n, at):
            self.seek(at)
            return self.read(n)

    found = list(warc.records(File(data), len(data), 0, len(data)))
    assert [c is None for _, c in found] == [False, False, True]


def test_archives_on_spark(spark):
    prepare(spark)
    big = "<p>é</p>" * 300
    rows = [(1, "u1", big), (5, None, big), (5, "u\n5", big), (3, "u3", "small"), (4, "u4", "small"), (None, "n", big), (8, "e", None), (9, "x", "y" * 999)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha1", F.lit(1)).withColumn("first", F.lit(2))
    manifest = warc.write_archives(warc.with_revisits(pages), new_folder(spark, "warc"), archive_bytes=700)
    for split in (64, 1 << 20):
        got = warc.read_archives(manifest, split).collect()
        assert len(got) == len(rows) and all(r.error is None for r in got)
        kinds = sorted((r.record_id, r.record_type, r.refers_to or "") for r in got)
        assert ("<urn:page:1>", "revisit", "<urn:page:5>") in kinds and ("<urn:page:>", "revisit", "<urn:page:5>") in kinds
        assert sum(k[1] == "response" for k in kinds) == 6
        assert all(r.declared_bytes == len(big.encode()) for r in got if r.record_type == "revisit")
    assert warc.read_archives(warc.write_archives(warc.with_revisits(pages.limit(0)), new_folder(spark, "warc"))).count() == 0
