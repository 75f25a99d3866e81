"""Incremental forms of the batch jobs, as Structured Streaming queries.

Building only what is new is a checkpointed file source: each run with
``availableNow`` takes the files that arrived since the last one and stops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from brinewave.operators.scoring import auc_counts
from brinewave.sources.sinks import by_slice
from brinewave.sources.wav import decode_chunks

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def new_files(spark: SparkSession, root: str, extension: str = "wav", files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*.{extension}")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(root)
    )


def ingest_new(spark: SparkSession, root: str, table: str, checkpoint: str, extension: str = "wav") -> StreamingQuery:
    """Append the chunks of files not seen before to the waveform table, then stop."""
    chunks = decode_chunks(new_files(spark, root, extension), extension)
    return (
        by_slice(chunks)
        .writeStream.format("parquet")
        .partitionBy("station", "date")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def running_auc_counts(scored: DataFrame, **kw) -> DataFrame:
    """Bucket counts of a stream of scored segments.

    The state is one row per score bucket however long the stream runs; write it
    in ``complete`` mode and read the area with ``auc_from_counts``.
    """
    return auc_counts(scored, **kw)
