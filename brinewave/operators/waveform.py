"""Decimated waveforms and the sample sets built from features."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewave.functions.curves import objective_curve
from brinewave.functions.kernels import decimate_column
from brinewave.functions.levels import resample_and_normalise
from brinewave.functions.picks import label_number
from brinewave.operators.spectral import resize


def decimated(
    segments: DataFrame,
    factor: int = 1,
    method: str = "iir",
    compat: bool = False,
    column: str = "waveform",
) -> DataFrame:
    """Low-passed and decimated samples as INT.

    Factor 1 leaves the signal as it is; ``compat`` runs the low-pass at 0.8 of
    Nyquist even then.
    """
    if factor == 1 and not compat:
        return segments.withColumn(column, F.transform("samples", lambda x: x.cast("int")))
    return segments.withColumn(column, decimate_column(F.col("samples"), factor, method))


def waveform_size(duration_s: float, fs: float) -> int:
    """Points of a waveform sample: the next power of two."""
    return 2 ** math.ceil(math.log2(duration_s * fs + 1))


def waveform_samples(
    rows: DataFrame,
    size: int,
    duration_s: float,
    width_s: float = 10.0,
    compat: bool = False,
    compat_half: bool = False,
) -> DataFrame:
    """Cut to size, resample, normalise, and add the objective curve.

    Input ``waveform`` and ``offsets``; output ``x`` and ``y`` of ``size``
    points. ``compat_half`` rounds the curve to 16-bit floats, which makes flat
    tops and so moves its peaks.
    """
    cut = F.slice("waveform", 1, size)
    return rows.withColumn("x", resample_and_normalise(cut, size, compat=compat)).withColumn(
        "y", objective_curve("offsets", size, duration_s, width_s, compat_half)
    )


def spectrogram_samples(
    rows: DataFrame, height: int, width: int, duration_s: float, width_s: float = 10.0
) -> DataFrame:
    """Resized image ``pixels`` and its objective curve ``y`` over the image width."""
    return resize(rows, "pixels", height, width).withColumn(
        "y", objective_curve("offsets", width, duration_s, width_s)
    )


def classifier_samples(rows: DataFrame, size: int = 128) -> DataFrame:
    """Square resized image and the class number of the row's label."""
    return resize(rows, "pixels", size, size).withColumn("y", label_number("label"))
