"""Data sets from an archive: catalog, segments, labels, features, manifest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewave.functions.timing import SECOND_US, format_stamp, parent_name, parse_stamp, stem, to_us
from brinewave.functions.kernels import neighbour_picks
from brinewave.operators import segments as seg
from brinewave.operators.features import segment_features
from brinewave.session import cut_lineage
from brinewave.sources import ranges, sinks, wav

HALF_US = 50 * SECOND_US


def ingest(spark: SparkSession, root: str, table: str, extension: str = "wav", by_range: bool = True) -> None:
    """Decode the files that the waveform table does not hold yet into it, by station and day.

    Files are read by byte ranges, and those that cannot be read, or end before their
    samples do, are added to ``<table>_problems`` from their headers. ``by_range=False`` is for
    stores that only Spark's own readers reach: whole files then go through the tasks.
    """
    files = wav.list_files(spark, root, extension)
    stored = sinks.read_if_exists(spark, table)
    if stored is not None:
        known = stored.select("station", "file_start_us").distinct()
        named = files.withColumn("station", parent_name("path")).withColumn("file_start_us", to_us(parse_stamp(stem("path"))))
        files = named.join(known, ["station", "file_start_us"], "left_anti").select(*files.columns)
    if by_range:
        files = files.select("path", "length")
    chunks = ranges.decode_ranges(files, extension) if by_range else wav.decode_chunks(files, extension)
    if extension == "wav":
        found = cut_lineage(wav.headers(files))
        cut = F.concat_ws(" ", F.lit("cut:"), "h.n_samples", F.lit("of"), "h.n_declared", F.lit("samples"))
        problems = found.select("path", F.coalesce("h.reason", F.when(F.col("h.n_samples") < F.col("h.n_declared"), cut)).alias("reason"))
        problems.where("reason IS NOT NULL").write.mode("append").parquet(f"{table}_problems")
    sinks.write_chunks(chunks, table)


def archive_rates(files: DataFrame) -> list[int]:
    """Sampling frequencies of an archive, one per kind of recorder: a short list."""
    return sorted(r["fs"] for r in files.select("fs").distinct().collect())


def archive_files(chunks: DataFrame) -> DataFrame:
    """``(station, start_us, end_us, fs, n_samples)`` per file, without reading any samples."""
    end = seg.samples_end(F.col("file_start_us"), F.col("file_samples"), F.col("fs"))
    return chunks.select(
        "station",
        F.col("file_start_us").alias("start_us"),
        end.alias("end_us"),
        "fs",
        F.col("file_samples").alias("n_samples"),
    ).distinct()


def labelled_test_tiles(annotations: DataFrame, stations: DataFrame, half_us: int = HALF_US) -> DataFrame:
    """Tiles over each station's configured period with their picks and label."""
    width = 2 * half_us
    known = stations.select("station", "start_us", "end_us")
    placed = seg.assign_tiles(annotations, known, width)
    return seg.label_tiles(seg.tiles(known, width), placed)


def tile_manifest(tiles: DataFrame, root: str, extension: str) -> DataFrame:
    path = seg.manifest_path(root, "label", "station", "center_us", extension)
    return tiles.withColumn("path", path)


def training_segments(annotations: DataFrame, half_us: int = HALF_US, multiplier: float = 1.0, seed: int = 0) -> DataFrame:
    """Shifted windows around positives with all picks inside, windows centered on negatives.

    ``annotations(station, event_id, label, at_us)``. The pick list comes in the
    order anchor, earlier, later; it is collapsed per tenth of a second.
    """
    positives = annotations.where("label = 'positive'")
    anchors = seg.anchored_segments(positives, half_us, multiplier, seed)
    listed = seg.neighbour_lists(anchors, positives, half_us)
    anchored = listed.withColumn("picks", neighbour_picks("near", "at_us", "center_us")).withColumn("label", F.lit("positive")).drop("near")
    negatives = annotations.where("label = 'negative'").select(
        "station",
        "event_id",
        "at_us",
        F.col("at_us").alias("center_us"),
        (F.col("at_us") - half_us).alias("seg_start_us"),
        (F.col("at_us") + half_us).alias("seg_end_us"),
        F.array().cast(anchored.schema["picks"].dataType).alias("picks"),
        F.lit("negative").alias("label"),
    )
    return anchored.unionByName(negatives)


def training_manifest(segments: DataFrame, root: str, extension: str) -> DataFrame:
    """Paths are named by the event itself, which the row carries."""
    name = F.concat(format_stamp("at_us"), F.lit("." + extension))
    folder = F.concat(F.col("label"), F.lit("s"))
    return segments.withColumn("path", F.concat_ws("/", F.lit(root), folder, "station", name))


def build(
    manifest: DataFrame,
    chunks: DataFrame,
    feature: str,
    out: str,
    half_us: int = HALF_US,
    tiling: DataFrame | None = None,
    **options,
) -> dict[str, DataFrame]:
    """Write features (missing ones only), the manifest, and the segments that cannot be served.

    A segment is built at the rate of the files it lies in; one that touches files of
    several rates is rejected. ``manifest`` rows carry ``path``, ``station``, the segment bounds, ``label``
    and ``picks``. For a tiled set, ``tiling`` (its stations) saves a shuffle of
    the samples.
    """
    spark = manifest.sparkSession
    files = archive_files(chunks)
    summary = seg.station_summary(files)
    checked = seg.check_coverage(manifest, summary)
    counted = seg.count_samples(checked, seg.file_pieces(files), 2 * half_us, rates=True)
    unserved = F.when(F.col("n_samples") == 0, "no samples").when(F.col("fs_low") < F.col("fs_high"), "several sampling rates")
    # read by the features, the manifest and the rejected rows
    counted = cut_lineage(counted.withColumn("reason", F.coalesce("reason", unserved)).withColumnRenamed("fs_low", "sampling_f"))
    served = counted.where("reason IS NULL")
    rates = archive_rates(files)
    wanted = served.select("path", "station", "label", "seg_start_us", "seg_end_us", "sampling_f")

    def compute(todo: DataFrame) -> DataFrame:
        parts = [
            segment_features(
                todo.where(F.col("sampling_f") == fs),
                chunks,
                feature,
                fs,
                2 * half_us,
                tiling,
                **options,
            )
            for fs in rates
        ]
        return reduce(DataFrame.unionByName, parts)

    sinks.write_new_features(compute, wanted, f"{out}/features", ["path"], ["station"])
    expected = (F.col("seg_end_us") - F.col("seg_start_us")) * F.col("sampling_f") / SECOND_US
    coverage = (F.col("n_samples") / expected).alias("coverage")
    sinks.write_manifest(
        served.select("path", "station", "label", "picks", coverage), f"{out}/manifest"
    )
    counted.where("reason IS NOT NULL").select("path", "station", "reason").write.mode(
        "overwrite"
    ).parquet(f"{out}/rejected")
    return {name: spark.read.parquet(f"{out}/{name}") for name in ("features", "manifest", "rejected")}
