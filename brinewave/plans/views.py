"""How the given tables stand in for stations, annotations, files and signals.

station = user, annotation = event, recorded file = time from one ``view`` event
to the next, detection height = value / 500, annotator count from ``props``,
waveform = embedding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewave.functions.timing import DAY_US, HOUR_US, floor_div, to_us
from brinewave.operators.ordered import number_and_next

TILE_US = 6 * HOUR_US
ANNOTATION_CLASSES = ["error", "click", "purchase"]
WAVE_FS = 8
WAVE_BASE_US = 1_704_067_200_000_000


def annotations(events: DataFrame) -> DataFrame:
    """``(event_id, station, at_us, class, height, k, n_annotators)``."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        "event_id",
        F.col("user_id").alias("station"),
        to_us("ts").alias("at_us"),
        F.col("event_type").alias("class"),
        (F.col("value") / F.lit(500.0)).alias("height"),
        k.alias("k"),
        (k % 3 + 1).alias("n_annotators"),
    )


def stations(events: DataFrame) -> DataFrame:
    return (
        events.select(F.col("user_id").alias("station"), to_us("ts").alias("at_us"))
        .groupBy("station")
        .agg(F.min("at_us").alias("start_us"), F.max("at_us").alias("end_us"))
    )


def files(events: DataFrame) -> DataFrame:
    """``(station, ordinal, start_us, end_us, next_us, fs, n_samples)``; fs is per hour.

    A file is named by its start, so equal starts of a station are one file. It
    holds the whole samples up to the next file; empty files are dropped.
    """
    views = annotations(events.where("event_type = 'view'"))
    starts = views.groupBy("station", "at_us").agg(
        F.when(F.max("k") >= 90, 120).otherwise(60).alias("fs")
    )
    numbered = number_and_next(starts, ["station"], "at_us")
    n = floor_div((F.col("next_us") - F.col("at_us")) * F.col("fs"), HOUR_US)
    return (
        numbered.where("next_us IS NOT NULL")
        .withColumn("n_samples", n)
        .where("n_samples > 0")
        .select(
            "station",
            "ordinal",
            F.col("at_us").alias("start_us"),
            (F.col("at_us") + floor_div(F.col("n_samples") * F.lit(HOUR_US) / F.col("fs"), 1)).alias("end_us"),
            "next_us",
            "fs",
            "n_samples",
        )
    )


def by_day(rows: DataFrame) -> DataFrame:
    return rows.withColumn("day", floor_div("at_us", DAY_US))


def waves(embeddings: DataFrame) -> DataFrame:
    return embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("samples"))


def wave_files(embeddings: DataFrame) -> DataFrame:
    """Embeddings as 16-bit WAV files: ``(path, length, content)`` like a file scan."""
    from brinewave.functions.timing import format_stamp
    from brinewave.sources.wav import encoded

    pcm = F.transform("embedding", lambda x: F.round(x.cast("double") * F.lit(10000.0)).cast("int"))
    start = F.lit(WAVE_BASE_US) + F.col("vec_id") * F.lit(8_000_000)
    path = F.concat(
        F.lit("archive/S"), F.floor(F.col("vec_id") / 100).cast("string"), F.lit("/"), format_stamp(start), F.lit(".wav")
    )
    return (
        embeddings.select(path.alias("path"), pcm.alias("pcm"))
        .withColumn("content", encoded("pcm", WAVE_FS))
        .select("path", (F.size("pcm") * 2 + 44).cast("bigint").alias("length"), "content")
    )
