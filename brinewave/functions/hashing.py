"""Seeded, engine-independent randomness built on md5.

A permutation or a draw depends on the seed and the row key only, never on the
partitioning, so a recomputed task gives the same rows again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brinewave.functions.timing import col


def seeded_key(seed: int, *keys: str | Column) -> Column:
    parts = [F.lit(str(seed))] + [col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws(":", *parts))


def hash01(seed: int, *keys: str | Column) -> Column:
    """Uniform draw in [0, 1) from the first 32 bits of the seeded key."""
    head = F.conv(F.substring(seeded_key(seed, *keys), 1, 8), 16, 10)
    return head.cast("double") / F.lit(4294967296.0)


def center_shift_us(seed: int, half_us: int, multiplier: float, *keys: str | Column) -> Column:
    """Random window shift, uniform in +-0.95 half widths times the multiplier."""
    draw = (hash01(seed, *keys) - F.lit(0.5)) * F.lit(1.9 * half_us * multiplier)
    return draw.cast("bigint")
