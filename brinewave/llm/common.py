"""Helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brinewave.session import configure

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_SQL: dict[str, str] = {}

# whole texts travel in Arrow batches; both bounds keep a worker's memory small
ARROW_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def prepare(spark: SparkSession) -> SparkSession:
    configure(spark)
    for key, value in ARROW_CONF.items():
        spark.conf.set(key, value)
    return spark


def llm_query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` and its SQL equivalent, if any."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        LLM_QUERIES[name] = run
        if sql is not None:
            LLM_SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, set here only where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = "file://" + tempfile.mkdtemp(prefix="brinewave-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if "://" not in folder and not folder.startswith("file:"):
        folder = "file://" + folder if folder.startswith("/") else folder
    return folder.rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, kind: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = new_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column | str) -> Column:
    """True for documents kept out of training: crc32 of the id as text, modulo 4, is 2."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string")) % 4 == 2, F.lit(False))


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column in one array, and the row offsets; null counts as empty."""
    column = pc.cast(pc.fill_null(column, ""), pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with about ``most`` text bytes; a longer row stands alone."""
    at = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        at = batch.schema.get_field_index(text) if at is None else at
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), np.int64)
        group = np.cumsum(sizes) // most
        cuts = np.flatnonzero(np.diff(group)) + 1
        start = 0
        for end in [*cuts.tolist(), batch.num_rows]:
            yield batch.slice(start, end - start)
            start = end


def schema_with(df: DataFrame, **fields: str) -> StructType:
    """The schema of ``df`` and more fields, given as name=type."""
    more = StructType()
    for name, kind in fields.items():
        more = more.add(name, kind)
    return StructType([*df.schema.fields, *more.fields])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that clashes with none of ``df`` (compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
