"""Probability curves: objective triangles, local maxima, suppression.

Everything works on one ARRAY column per segment, so nothing is shuffled and
the work per row is bounded by the number of time steps of a segment.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewave.functions.kernels import peaks_column, triangle_column
from brinewave.functions.timing import col

PEAKS = "array<struct<i:int,h:double>>"


def objective_curve(
    offsets: str | Column, n: int, duration_s: float, width_s: float, compat_half: bool = False
) -> Column:
    """Triangles of half width ``width_s`` around offsets given from the segment center.

    Zero everywhere without an offset. ``compat_half`` rounds to 16-bit floats,
    which makes flat tops and so moves the peaks of the curve.
    """
    step = duration_s / n
    at = F.transform(col(offsets), lambda o: (F.lit(duration_s / 2) + o) / F.lit(step))
    return triangle_column(at, n, width_s / step, compat_half)


def local_maxima(curve: str | Column) -> Column:
    """Peaks of a curve as ``array<struct<i,h>>``.

    One pass: a rise opens a candidate top, an equal value extends it, a fall
    closes it in its middle (rounded down). Ends are never peaks.
    """
    start = F.struct(
        F.lit(0).alias("i"),
        F.lit(None).cast("double").alias("prev"),
        F.lit(-1).alias("top"),
        F.array().cast(PEAKS).alias("peaks"),
    )

    def advance(acc: Column, raw: Column) -> Column:
        x = raw.cast("double")
        falls = x < acc["prev"]
        middle = F.floor((acc["top"] + acc["i"] - 1) / 2).cast("int")
        peak = F.struct(middle.alias("i"), acc["prev"].alias("h"))
        return F.struct(
            (acc["i"] + 1).alias("i"),
            x.alias("prev"),
            F.when(x > acc["prev"], acc["i"]).when(falls, F.lit(-1)).otherwise(acc["top"]).alias("top"),
            F.when(falls & (acc["top"] >= 0), F.concat(acc["peaks"], F.array(peak)))
            .otherwise(acc["peaks"])
            .alias("peaks"),
        )

    return F.aggregate(col(curve), start, advance, lambda acc: acc["peaks"])


def at_least(peaks: Column, height: float) -> Column:
    return F.filter(peaks, lambda p: p["h"] >= F.lit(height))


def suppress_close(peaks: Column, distance: float) -> Column:
    """Keep the highest peaks and drop those fewer than ``ceil(distance)`` steps away.

    Equal heights are visited from the later index on.
    """
    gap = math.ceil(distance)
    ranked = F.sort_array(
        F.transform(peaks, lambda p: F.struct(p["h"].alias("h"), p["i"].alias("i"))), asc=False
    )

    def keep(acc: Column, p: Column) -> Column:
        near = F.exists(acc, lambda k: F.abs(k["i"] - p["i"]) < gap)
        here = F.array(F.struct(p["i"].alias("i"), p["h"].alias("h")))
        return F.when(near, acc).otherwise(F.concat(acc, here))

    return F.array_sort(F.aggregate(ranked, F.array().cast(PEAKS), keep))


def find_peaks(curve: str | Column, height: float, distance: float | None = None) -> Column:
    """Peaks of at least ``height`` and ``ceil(distance)`` steps apart, as ``array<struct<i,h>>``.

    Same result as ``suppress_close(at_least(local_maxima(...)))``. Those
    expressions append to arrays, which is quick for curves of a few hundred
    steps and quadratic in the number of peaks beyond; this kernel is not.
    """
    gap = None if distance is None else math.ceil(distance)
    return peaks_column(col(curve).cast("array<double>"), height, gap)


def peak_seconds(peaks: Column, step_s: float) -> Column:
    """Peak list with positions in seconds: ``array<struct<pos_s,h>>``."""
    return F.transform(
        peaks, lambda p: F.struct((p["i"] * F.lit(step_s)).alias("pos_s"), p["h"].alias("h"))
    )


def unnest(df: DataFrame, keys: list[str], array: str, position: str, value: str) -> DataFrame:
    """``(*keys, position, value)`` per element; empty and null arrays give no row.

    The outer form keeps Spark from inferring a filter on the array. Such a
    filter is pushed below the projection and would run the kernel that makes
    the array a second time.
    """
    each = df.select(*keys, F.posexplode_outer(array).alias(position, value))
    return each.where(F.col(position).isNotNull())
