"""Spectrograms of segments: kernel, band, clamp, pixels, resize, viewport."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewave.functions.curves import unnest
from brinewave.functions.kernels import image_column, resize_images
from brinewave.functions.levels import to_pixel
from brinewave.functions.timing import HOUR_US, SECOND_US, floor_div
from brinewave.operators.rangejoin import points_in_intervals


def hop_of(nperseg: int, overlap: float) -> int:
    return nperseg - int(nperseg * overlap)


def nearest_bin(frequency: float, fs: float, nperseg: int) -> int:
    """Frequency bin closest to a bound; the lower one on a tie."""
    bins = [abs(frequency - k * fs / nperseg) for k in range(nperseg // 2 + 1)]
    return bins.index(min(bins))


def band(fs: float, nperseg: int, f_min: float = 0.0, f_max: float | None = None) -> tuple[int, int]:
    """First bin and end bin (exclusive) of a frequency band.

    Without ``f_max`` every bin from the lower bound on is kept; with it the bin
    nearest to ``f_max`` is already outside.
    """
    low = nearest_bin(f_min, fs, nperseg)
    if not f_max:
        return low, nperseg // 2 + 1
    return low, max(nearest_bin(f_max, fs, nperseg), low)


def spectrogram(
    segments: DataFrame,
    fs: float,
    nperseg: int = 256,
    overlap: float = 0.5,
    apply_log: bool = True,
    f_min: float = 0.0,
    f_max: float | None = None,
    vmin: float | None = None,
    vmax: float | None = None,
) -> DataFrame:
    """Add ``spectro``: ARRAY of frequency rows (descending), each an ARRAY over time.

    Bounds that are not given are the smallest and largest value of the segment
    itself. Frames start at the segment's first sample.
    """
    image = image_column(
        F.col("samples"),
        fs,
        nperseg,
        hop_of(nperseg, overlap),
        band(fs, nperseg, f_min, f_max),
        apply_log,
        vmin,
        vmax,
    )
    return segments.withColumn("spectro", image)


def long_form(
    spectra: DataFrame, keys: list[str], fs: float, nperseg: int, overlap: float = 0.5,
    f_min: float = 0.0, f_max: float | None = None,
) -> DataFrame:
    """``(*keys, f_bin, t_bin, f, t, v)``, one row per spectrogram value."""
    _, hi = band(fs, nperseg, f_min, f_max)
    hop = hop_of(nperseg, overlap)
    rows = unnest(spectra, keys, "spectro", "_row", "_values")
    cells = unnest(rows, [*keys, "_row"], "_values", "t_bin", "v").withColumn(
        "f_bin", F.lit(hi - 1) - F.col("_row")
    )
    return cells.select(
        *keys,
        "f_bin",
        "t_bin",
        (F.col("f_bin") * F.lit(fs / nperseg)).alias("f"),
        ((F.lit(nperseg / 2) + F.col("t_bin") * F.lit(hop)) / F.lit(float(fs))).alias("t"),
        "v",
    )


def pixels(spectra: DataFrame, vmin: float, vmax: float) -> DataFrame:
    """Spectrogram values as truncated 0..255 pixels."""
    return spectra.withColumn(
        "pixels", F.transform("spectro", lambda r: F.transform(r, lambda v: to_pixel(v, vmin, vmax)))
    )


def resize(images: DataFrame, column: str, height: int, width: int) -> DataFrame:
    """Bilinear resampling of an image column to height x width.

    A plan node of its own (``mapInArrow``) and not an expression: images come
    out of a kernel already, and a call on top of a call can be split wrongly
    when filters are moved.
    """
    ready = images.withColumn(column, F.col(column).cast("array<array<double>>"))
    place = ready.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            resized = resize_images(batch.column(place), height, width)
            yield batch.set_column(place, column, resized)

    return ready.mapInArrow(run, ready.schema)


def viewport(frames: DataFrame, requests: DataFrame, f_lo: float, f_hi: float, width_us: int) -> DataFrame:
    """Archive spectrogram values inside requested windows, time relative to their center.

    ``frames(station, frame_us, f, v)``, ``requests(request, station, center_us,
    length_us)``.
    """
    windows = request_windows(requests)
    inside = frames.where((F.col("f") >= f_lo) & (F.col("f") <= f_hi))
    found = points_in_intervals(
        inside, windows, ["station"], "frame_us", "v_start", "v_end", width_us, closed_right=True
    )
    return relative(found)


def request_windows(requests: DataFrame) -> DataFrame:
    half = (F.col("length_us") / 2).cast("bigint")
    return requests.select(
        "request",
        "station",
        "center_us",
        (F.col("center_us") - half).alias("v_start"),
        (F.col("center_us") + half).alias("v_end"),
    )


def relative(found: DataFrame) -> DataFrame:
    return found.withColumn(
        "t_rel", (F.col("frame_us") - F.col("center_us")) / F.lit(float(SECOND_US))
    ).drop("v_start", "v_end")


def requested_only(rows: DataFrame, requests: DataFrame, start: str, end: str, width_us: int) -> DataFrame:
    """``rows(station, start, end, ...)`` that touch a requested window, once each.

    Windows are cut into cells first, so rows meet a short list of cells and nothing is
    paired; what is left can then be transformed.
    """
    windows = request_windows(requests)
    cell = F.explode(F.sequence(floor_div("v_start", width_us), floor_div("v_end", width_us)))
    # a row is told by its first and last cell: it must be no longer than a cell
    wanted = windows.select("station", cell.alias("_cell")).distinct()
    near = wanted.select("station", F.explode(F.array(F.col("_cell"), F.col("_cell") + 1)).alias("_end_cell")).distinct()
    cut = rows.withColumn("_end_cell", floor_div(end, width_us))
    return cut.join(near, ["station", "_end_cell"], "left_semi").drop("_end_cell")


def stored_viewport(frames: DataFrame, requests: DataFrame, f_lo: float, f_hi: float) -> DataFrame:
    """``viewport`` of frames that ``sinks.write_frames`` stored: requests name their hours, other folders are not read.

    Spark prunes folders by the requests at run time where it broadcasts them.
    """
    hours = F.explode(F.sequence(floor_div("v_start", HOUR_US), floor_div("v_end", HOUR_US)))
    windows = request_windows(requests).withColumn("hour", hours)
    inside = frames.where((F.col("f") >= f_lo) & (F.col("f") <= f_hi))
    met = inside.join(windows, ["station", "hour"]).where((F.col("frame_us") >= F.col("v_start")) & (F.col("frame_us") <= F.col("v_end")))
    return relative(met.drop("hour"))
