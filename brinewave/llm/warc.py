"""WARC archives: a deduplicating writer and a splittable reader.

Writing: every record is a gzip member of its own. A task writes its rows to files of at
most ``ARCHIVE_BYTES`` under names nobody else uses and returns them; only the files that
successful tasks return are in the manifest, so lost or repeated tasks do no harm. Payloads
of at least ``REVISIT_BYTES`` that occur several times are stored once, by the record with
the largest id; the others are revisit records that refer to it.

Reading: a task gets byte ranges. It looks for the gzip magic from the start of its range,
takes a candidate for a member only if its first bytes decode to a WARC version line, and
owns every record that starts inside the range, reading past the end to finish the last
one. So every record is read by one task, whatever the ranges. A file never has to fit in
memory, a record does.

Files are opened by ``pyarrow.fs`` from their URI, so the folder may be local and shared,
HDFS or an object store.

Defined cases: null payloads are empty; a null url leaves the field out; line breaks in urls
are percent-encoded; an empty table gives no archive; equal rows give equal records; bytes
between members, and members that are no WARC record, are skipped; a record cut by the end
of its file is reported with ``error`` set.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewave.llm.common import llm_query, materialise, new_folder, slices, table

ARCHIVE_BYTES = 1 << 30
SPLIT_BYTES = 8 << 20
REVISIT_BYTES = 1000
_READ = 1 << 18
_MAGIC = b"\x1f\x8b\x08"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, refers_to: int | None) -> bytes:
    """One compressed record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def with_revisits(pages: DataFrame, key: str = "page_id", payload: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """``(page_id, url, payload, refers_to)``: where the payload is stored, if not with the row itself."""
    rows = pages.select(
        F.col(key).alias("page_id"), F.col("url"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload")
    ).withColumn("sha1", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= least)
    repeated = large.groupBy("sha1").agg(F.max("page_id").alias("first"), F.count("*").alias("times")).where("times > 1 and first is not null")
    found = rows.join(repeated.select("sha1", "first"), "sha1", "left")
    away = (F.col("page_id") != F.col("first")) | (F.col("page_id").isNull() & F.col("first").isNotNull())
    refers = F.when((F.octet_length("payload") >= least) & away, F.col("first"))
    return found.select("page_id", "url", "payload", refers.alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``with_revisits`` rows below ``folder``; returns the manifest ``(path, n_bytes, n_records)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, file, size, count, done = "", None, 0, 0, []
        for batch in slices(batches, "payload", 4 << 20):
            for row in batch.to_pylist():
                if file is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    file = store.open_output_stream(f"{root}/{name}", compression=None)
                member = _record(row["page_id"], row["url"], row["payload"], hashlib.sha1(row["payload"]).digest(), row["refers_to"])
                file.write(member)
                size, count = size + len(member), count + 1
                if size >= archive_bytes:
                    file.close()
                    done.append((f"{folder}/{name}", size, count))
                    file = None
        if file is not None:
            file.close()
            done.append((f"{folder}/{name}", size, count))
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "n_bytes", "n_records"]
        )

    return materialise(rows.mapInArrow(run, "path string, n_bytes long, n_records long"), "manifest")


class _Window:
    """Bytes of a file from a moving position on."""

    def __init__(self, file, size: int, at: int):
        self.file, self.size, self.at, self.data = file, size, at, b""

    def more(self) -> bool:
        got = self.file.read_at(min(_READ, max(0, self.size - self.at - len(self.data))), self.at + len(self.data))
        self.data += got
        return bool(got)

    def skip(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


def _is_record(data: bytes) -> bool:
    """True if a gzip member that starts here decodes to a WARC version line."""
    try:
        return zlib.decompressobj(31).decompress(data[:4096], 16).startswith(b"WARC/")
    except zlib.error:
        return False


def records(file, size: int, start: int, end: int) -> Iterator[tuple[int, bytes | None]]:
    """``(offset, content)`` of the records that start in [start, end); None for one the file cuts off."""
    window = _Window(file, size, start)
    while window.at < end:
        found = window.data.find(_MAGIC)
        if found < 0:
            window.skip(max(0, len(window.data) - 2))
            if not window.more():
                return
            continue
        window.skip(found)
        if window.at >= end:
            return
        while len(window.data) < 4096 and window.more():
            pass
        if not _is_record(window.data):
            window.skip(1)
            continue
        offset, unpack, parts = window.at, zlib.decompressobj(31), []
        try:
            while not unpack.eof:
                if not window.data and not window.more():
                    yield offset, None
                    return
                piece = window.data
                parts.append(unpack.decompress(piece))
                window.skip(len(piece) - len(unpack.unused_data))
        except zlib.error:
            yield offset, None
            window = _Window(file, size, offset + 1)
            continue
        yield offset, b"".join(parts)


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def parse_record(content: bytes) -> dict:
    """Fields of a record; ``payload`` is what follows the HTTP header, None for a revisit."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields.get("content-length", len(rest)))]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = fields.get("warc-type")
    return {
        "record_type": kind,
        "record_id": fields.get("warc-record-id"),
        "url": fields.get("warc-target-uri"),
        "refers_to": fields.get("warc-refers-to"),
        "declared_sha1": base64.b32decode(digest).hex() if len(digest) == 32 else digest or None,
        "declared_bytes": int(_fields(http).get("content-length", len(payload))),
        "payload": None if kind == "revisit" else payload,
    }


_KINDS = {
    "path": pa.string(), "offset": pa.int64(), "record_type": pa.string(), "record_id": pa.string(), "url": pa.string(),
    "refers_to": pa.string(), "declared_sha1": pa.string(), "declared_bytes": pa.int64(), "payload": pa.binary(), "error": pa.string(),
}
_SCHEMA = "path string, offset long, record_type string, record_id string, url string, refers_to string, declared_sha1 string, declared_bytes long, payload binary, error string"


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All records of the files in ``manifest(path, n_bytes)``, read in ranges of ``split_bytes``."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    splits = manifest.select("path", "n_bytes", starts.alias("start"))
    # one task for each range; the number of ranges is one aggregated row
    count = manifest.agg(F.sum(F.ceil(F.col("n_bytes") / split_bytes)).alias("n")).first().n or 1
    splits = splits.repartition(min(int(count), 20_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(row["path"])
                with store.open_input_file(path) as file:
                    for offset, content in records(file, row["n_bytes"], row["start"], row["start"] + split_bytes):
                        found = parse_record(content) if content is not None else {"error": "cut or damaged"}
                        out.append({"path": row["path"], "offset": offset} | found)
                        held += len(content or b"")
                        if held > 4 << 20:
                            yield _batch(out)
                            out, held = [], 0
        yield _batch(out)

    return splits.mapInArrow(run, _SCHEMA)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in _KINDS.items()], list(_KINDS))


def _page(col: str) -> Column:
    return F.expr(f"try_cast(nullif(regexp_extract({col}, '^<urn:page:(-?[0-9]+)>$', 1), '') as bigint)")


SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, octet_length(encode(h)) as payload_bytes, sha1(h) as payload_digest from p),
f as (select payload_digest, max(page_id) as top from d where payload_bytes >= 1000 group by all)
select page_id, payload_bytes, d.payload_digest,
  case when top is null or top = page_id then 'response' else 'revisit' end as record_type,
  case when top <> page_id then top end as refers_to
from d left join f on f.payload_digest = d.payload_digest and payload_bytes >= 1000
"""


@llm_query("op8_warc_splittable", SQL)
def op8(spark, sf_dir):
    """Every page written to archives and read back by byte ranges."""
    manifest = write_archives(with_revisits(table(spark, sf_dir, "pages")), new_folder(spark, "warc"))
    found = read_archives(manifest)
    response = F.col("record_type") == "response"
    return found.where("error is null").select(
        _page("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload")).otherwise(F.col("declared_bytes")).cast("long").alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("declared_sha1")).alias("payload_digest"),
        "record_type",
        _page("refers_to").alias("refers_to"),
    )
