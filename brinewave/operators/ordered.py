"""Ordered operators that never put one whole key, or the whole table, in one task.

A window over a station, a label or a sorted score column puts that group into
a single task. Here every group is cut into spans first; the window runs inside
a span, and a small per-span summary (one row per span, so its size depends on
the number of spans and not on the number of rows) carries totals and edges
from one span to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinewave.functions.hashing import seeded_key
from brinewave.functions.timing import DAY_US, floor_div

BEFORE = (Window.unboundedPreceding, -1)


def _carry_counts(df: DataFrame, groups: list[str], span: str, *extra: Column) -> DataFrame:
    """Per span: rows in earlier spans of the group, plus further columns over the summary."""
    heads = df.groupBy(*groups, span).agg(F.count("*").alias("_n"), *extra)
    over = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    run = over.orderBy(span)
    return heads.withColumn(
        "_before", F.coalesce(F.sum("_n").over(run.rowsBetween(*BEFORE)), F.lit(0))
    )


def number_and_next(
    df: DataFrame,
    keys: list[str],
    at_us: str,
    span_us: int = DAY_US,
    ordinal: str = "ordinal",
    following: str = "next_us",
) -> DataFrame:
    """Zero-based position of a row within its key in time order, and the next row's time.

    Times are distinct within a key (collapse copies first), so a window holds
    no more rows than a span has instants.
    """
    cut = df.withColumn("_span", floor_div(at_us, span_us))
    inside = Window.partitionBy(*keys, "_span").orderBy(at_us)
    numbered = cut.withColumn("_rn", F.row_number().over(inside)).withColumn(
        "_next", F.lead(at_us).over(inside)
    )
    carry = _carry_counts(cut, keys, "_span", F.min(at_us).alias("_head")).withColumn(
        "_next_head", F.lead("_head").over(Window.partitionBy(*keys).orderBy("_span"))
    )
    joined = numbered.join(carry.drop("_n", "_head"), [*keys, "_span"])
    return (
        joined.withColumn(ordinal, F.col("_before") + F.col("_rn") - 1)
        .withColumn(following, F.coalesce("_next", "_next_head"))
        .drop("_span", "_rn", "_next", "_before", "_next_head")
    )


def shuffled_rank(
    df: DataFrame,
    groups: list[str],
    key: str,
    seed: int,
    rank: str = "rank",
    hex_digits: int = 3,
    totals: dict[str, Column] | None = None,
) -> DataFrame:
    """Zero-based rank of each row in a seeded shuffle of its group.

    Rows are ordered by md5(seed:key); the leading hex digits are the span, so
    the spans are of equal size whatever the groups look like. ``totals`` are
    sums over per-span counts of all groups, evaluated on the summary only.
    """
    hashed = df.withColumn("_h", seeded_key(seed, key)).withColumn(
        "_span", F.substring("_h", 1, hex_digits)
    )
    carry = _carry_counts(hashed, groups, "_span")
    everything = Window.partitionBy(F.lit(0))
    for name, value in (totals or {}).items():
        carry = carry.withColumn(name, F.coalesce(F.sum(value).over(everything), F.lit(0)))
    inside = Window.partitionBy(*groups, "_span").orderBy("_h", key)
    ranked = hashed.withColumn("_rn", F.row_number().over(inside))
    return (
        ranked.join(carry.drop("_n"), [*groups, "_span"])
        .withColumn(rank, F.col("_before") + F.col("_rn") - 1)
        .drop("_h", "_span", "_rn", "_before")
    )
