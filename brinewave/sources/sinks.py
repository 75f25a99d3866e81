"""Writers. Outputs are partitioned Parquet folders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from brinewave.functions.timing import HOUR_US, floor_div
from brinewave.operators.segments import missing_only

RESULT_KEYS = ["model", "dataset", "min_annot"]


def read_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


#: samples that one task writes of a station and day, about 512 MB
SLICE_SAMPLES = 1 << 26


def by_slice(chunks: DataFrame) -> DataFrame:
    """Waveform rows with their ``date``, dealt out by station, day and slice.

    A day has as many slices as its sampling rate fills, so a busy recorder is written by
    several tasks.
    """
    slices = F.greatest(F.ceil(F.col("fs") * F.lit(86400.0) / SLICE_SAMPLES), F.lit(1))
    piece = F.pmod(F.xxhash64("file_start_us", "first_sample"), slices)
    dated = chunks.withColumn("date", F.to_date(F.timestamp_micros("chunk_us"))).withColumn("_slice", piece)
    return dated.repartition("station", "date", "_slice").drop("_slice")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Waveform table, by station and day."""
    (
        by_slice(chunks)
        .write.mode("append")
        .partitionBy("station", "date")
        .parquet(path)
    )


def write_files(files: DataFrame, root: str) -> None:
    """``(path, content)`` rows as files below ``root``; a task that runs again replaces its own files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme, place = root.split(":", 1) if ":" in root.split("/", 1)[0] else ("file", root)
        store, base = (fs.LocalFileSystem(), "/" + place.lstrip("/")) if scheme == "file" else fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store.create_dir(f"{base}/{path}".rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(f"{base}/{path}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    files.select("path", "content").mapInArrow(run, "n long").agg({"n": "sum"}).collect()


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").parquet(path)


def write_manifest_csv(manifest: DataFrame, path: str, counted: bool = True, indexed: bool = False, runs: bool = False) -> None:
    """Manifest as ragged text lines; ``indexed`` puts the row's ``idx`` after its path, ``runs`` counts copies."""
    from brinewave.sources.tables import manifest_line

    line = manifest_line(F.col("path"), F.col("label"), F.col("picks"), counted, F.col("idx") if indexed else None, runs)
    manifest.select(line.alias("value")).write.mode("overwrite").text(path)


def write_new_features(
    compute: Callable[[DataFrame], DataFrame],
    wanted: DataFrame,
    path: str,
    keys: list[str],
    partition: list[str],
) -> None:
    """Compute and append only the features that are not stored yet.

    ``compute`` maps the missing rows of ``wanted`` to the rows to store, so a
    second run over the same segments reads keys and writes nothing.
    """
    stored = read_if_exists(wanted.sparkSession, path)
    todo = wanted if stored is None else missing_only(wanted, stored, keys)
    compute(todo).write.mode("append").partitionBy(*partition).parquet(path)


def write_buckets(rows: DataFrame, table: str, path: str, keys: list[str], buckets: int) -> DataFrame:
    """A feature table dealt out by its keys once: joins by them move the other side only.

    The number of buckets holds for the table's life; about 128 MB a bucket suits a scan.
    """
    dealt = rows.repartition(buckets, *keys)  # one file for each bucket
    dealt.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).mode("overwrite").saveAsTable(table)
    return rows.sparkSession.table(table)


def open_buckets(spark: SparkSession, table: str, path: str, keys: list[str], buckets: int) -> DataFrame:
    """A table that ``write_buckets`` made in another session, under a name in this one."""
    fields = spark.read.parquet(path).schema
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    by = ", ".join(f"`{k}`" for k in keys)
    place = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{place}'")
    return spark.table(table)


def write_frames(frames: DataFrame, path: str) -> None:
    """Archive spectrogram by station and hour, which a viewport prunes by."""
    hourly = frames.withColumn("hour", floor_div("frame_us", HOUR_US))
    hourly.repartition("station", "hour").write.mode("append").partitionBy("station", "hour").parquet(path)


def write_results(results: DataFrame, path: str) -> None:
    """Evaluation results by (model, dataset, min_annot); a rerun replaces its own folder."""
    (
        results.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*RESULT_KEYS)
        .parquet(path)
    )
