"""Amplitude and pixel expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brinewave.functions.kernels import peak_column, waveform_column
from brinewave.functions.timing import col

# Display range of the stored pixels in dB, and the contrast floor
PIXEL_VMIN = -35.0
PIXEL_VMAX = 140.0
CONTRAST_FLOOR = 95 * 255 / 175
# Accepted amplitude range of a waveform sample
AMPLITUDE_MIN = 10 ** (-35 / 20)
AMPLITUDE_MAX = 10 ** (140 / 20)


def power_db(x: str | Column) -> Column:
    return F.lit(10.0) * F.log10(col(x) + F.lit(1e-20))


def rescale(x: str | Column, vmin: float, vmax: float) -> Column:
    return F.lit(255.0) * (col(x) - F.lit(vmin)) / F.lit(vmax - vmin)


def to_pixel(x: str | Column, vmin: float = PIXEL_VMIN, vmax: float = PIXEL_VMAX) -> Column:
    """0..255 pixel; the cast truncates."""
    return rescale(x, vmin, vmax).cast("smallint")


def contrast(unit: str | Column) -> Column:
    """Contrast-floored display value of a pixel given in [0, 1]."""
    lifted = F.greatest(col(unit) * F.lit(255.0) - F.lit(CONTRAST_FLOOR), F.lit(0.0))
    return lifted / F.lit(255.0 - CONTRAST_FLOOR)


def resample_and_normalise(
    samples: str | Column,
    n: int,
    vmin: float = AMPLITUDE_MIN,
    vmax: float = AMPLITUDE_MAX,
    compat: bool = False,
) -> Column:
    """Linear interpolation onto n points, then amplitudes within [-1, 1].

    Values below ``vmin`` become 0 and values above ``vmax`` about 1; ``compat``
    drops their sign. Arrays shorter than two samples give null.
    """
    return waveform_column(col(samples).cast("array<double>"), n, vmin, vmax, compat)


def peak_normalise(samples: str | Column) -> Column:
    """16-bit integers relative to the largest amplitude; nulls for silence."""
    return peak_column(col(samples).cast("array<double>"))


def next_power_of_two(x: int | Column) -> Column:
    x = x if isinstance(x, Column) else F.lit(x)
    return F.pow(F.lit(2.0), F.ceil(F.log2(x))).cast("bigint")


def hamming(i: Column, n: int) -> Column:
    """Weight i of a periodic Hamming window of n points."""
    return F.lit(0.54) - F.lit(0.46) * F.cos(F.lit(2.0) * F.pi() * i / F.lit(float(n)))
