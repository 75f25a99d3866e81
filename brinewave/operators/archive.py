"""Spectrogram of a whole archive on one time grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewave.functions.curves import unnest
from brinewave.functions.kernels import spectrogram_column
from brinewave.functions.levels import power_db


def archive_frames(chunks: DataFrame, fs: int, nperseg: int = 256, hop: int = 128) -> DataFrame:
    """Frames ``(station, frame_us, f_bin, f, v)`` over the waveform table.

    Every file is one grid from its first sample, whatever the chunks' length: a chunk
    holds the frames that begin in it, the first one at the next multiple of the hop, and
    takes what they need beyond its end from its halo. No samples are moved.
    """
    reach = nperseg - 1
    body = chunks.where(F.col("fs") == fs)
    size = F.size("samples")
    lead = F.pmod(-F.col("first_sample"), F.lit(hop)).cast("int")
    behind = F.least(F.col("file_samples") - F.col("first_sample") - size, F.lit(reach))
    short = F.raise_error(F.lit(f"chunks need a halo of {reach} samples"))
    halo = F.when(F.size("halo") >= behind, F.slice("halo", 1, reach)).otherwise(short.cast("array<double>"))
    power = body.select(
        "station",
        "file_start_us",
        (F.col("first_sample") + lead).alias("_at"),
        spectrogram_column(F.concat(F.slice("samples", lead + 1, size), halo), float(fs), nperseg, hop).alias("_power"),
    )
    frames = unnest(power, ["station", "file_start_us", "_at"], "_power", "_k", "_bins")
    middle = (F.col("_at") + F.lit(nperseg / 2) + F.col("_k") * F.lit(hop)) * F.lit(1e6 / fs)
    timed = frames.withColumn("frame_us", F.col("file_start_us") + F.round(middle).cast("bigint"))
    return unnest(timed, ["station", "frame_us"], "_bins", "f_bin", "_p").select(
        "station",
        "frame_us",
        "f_bin",
        (F.col("f_bin") * F.lit(fs / nperseg)).alias("f"),
        power_db("_p").alias("v"),
    )
