"""Range joins as equi-joins on time cells.

A pure range condition plans a nested-loop join. Cutting time into cells turns
it into an equi-join on (keys, cell) plus a residual filter: Spark shuffles it
like any other join, AQE may turn it into a broadcast join after it has measured
the smaller side, and splits a cell that is too large (skew join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewave.functions.timing import floor_div


def cells(lo: Column, hi: Column, width: int) -> Column:
    return F.explode(F.sequence(floor_div(lo, width), floor_div(hi, width)))


def points_in_intervals(
    points: DataFrame,
    intervals: DataFrame,
    keys: list[str],
    at: str,
    lo: str,
    hi: str,
    width: int,
    how: str = "inner",
    closed_right: bool = False,
) -> DataFrame:
    """Join each point to the intervals with ``lo <= at < hi`` (or ``<=``).

    A point lies in one cell, so no pair is found twice and ``how='left'`` is safe.
    """
    cut_points = points.withColumn("_cell", floor_div(at, width))
    # the keys of the intervals get names of their own: both sides may come from one table
    other = {k: f"_of_{k}" for k in [*keys, "_cell"]}
    cut_intervals = intervals.withColumn("_cell", cells(F.col(lo), F.col(hi), width)).withColumnsRenamed(other)
    upper = F.col(at) <= F.col(hi) if closed_right else F.col(at) < F.col(hi)
    on = (F.col(at) >= F.col(lo)) & upper
    for k, name in other.items():
        on = (F.col(k) == F.col(name)) & on
    return cut_points.join(cut_intervals, on, how).drop("_cell", *other.values())


def overlaps(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    width: int,
) -> DataFrame:
    """Pairs of half-open intervals that overlap.

    Both sides are listed in every cell they touch; a pair counts only in the
    cell where the later of the two starts, so it comes out once.
    """
    l_lo, l_hi = left_span
    r_lo, r_hi = right_span
    a = left.withColumn("_cell", cells(F.col(l_lo), F.col(l_hi), width))
    b = right.withColumn("_cell", cells(F.col(r_lo), F.col(r_hi), width))
    meet = (
        (F.col(l_lo) < F.col(r_hi))
        & (F.col(r_lo) < F.col(l_hi))
        & (F.col("_cell") == floor_div(F.greatest(F.col(l_lo), F.col(r_lo)), width))
    )
    return a.join(b, [*keys, "_cell"]).where(meet).drop("_cell")
