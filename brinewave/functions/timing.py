"""Time, text-stamp and path expressions (all JVM-side columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brinewave.schemas import STAMP

SECOND_US = 1_000_000
MINUTE_US = 60 * SECOND_US
HOUR_US = 3600 * SECOND_US
DAY_US = 24 * HOUR_US

# tolerance when two instants are compared: fixed value
EPSILON_US = 10_000


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_us(ts: str | Column) -> Column:
    """TIMESTAMP_NTZ -> microseconds since the epoch (session zone must be UTC)."""
    return F.unix_micros(col(ts).cast("timestamp"))


def from_us(us: str | Column) -> Column:
    return F.timestamp_micros(col(us)).cast("timestamp_ntz")


def parse_stamp(text: str | Column) -> Column:
    """``20200607_034350`` -> TIMESTAMP_NTZ, null when malformed."""
    return F.try_to_timestamp(col(text), F.lit(STAMP)).cast("timestamp_ntz")


def format_stamp(us: str | Column) -> Column:
    return F.date_format(from_us(us), STAMP)


def floor_div(a: str | Column, b: int) -> Column:
    """Integer division that also floors negative operands."""
    return F.floor(col(a) / F.lit(float(b))).cast("bigint")


def ceil_div(a: str | Column, b: int) -> Column:
    return F.ceil(col(a) / F.lit(float(b))).cast("bigint")


def seconds(us: str | Column) -> Column:
    return col(us) / F.lit(1e6)


def nearest_second(us: str | Column) -> Column:
    """Nearest whole second; an exact half rounds down, as the fraction's half-even does."""
    base = floor_div(us, SECOND_US)
    frac = col(us) - base * SECOND_US
    return (base + F.when(frac > SECOND_US // 2, 1).otherwise(0)) * SECOND_US


def offset_tenths(us: str | Column) -> Column:
    """Microseconds -> tenths of a second, half to even, computed on integers."""
    q = floor_div(us, 100_000)
    rest = col(us) - q * 100_000
    up = (rest > 50_000) | ((rest == 50_000) & (q % 2 != 0))
    return q + F.when(up, 1).otherwise(0)


def one_decimal(us: str | Column) -> Column:
    return offset_tenths(us) / F.lit(10.0)


def midpoint(start_us: str | Column, end_us: str | Column) -> Column:
    return col(start_us) + F.floor((col(end_us) - col(start_us)) / 2).cast("bigint")


def around(center_us: str | Column, length_us: int | Column) -> tuple[Column, Column]:
    """Window of a given length around a center, as (start, end)."""
    half = length_us / 2 if isinstance(length_us, Column) else F.lit(length_us / 2)
    half = half.cast("bigint")
    return col(center_us) - half, col(center_us) + half


def samples_duration(n: str | Column, fs: str | Column) -> Column:
    """Duration in microseconds of n samples at fs Hz (rounded to the microsecond)."""
    return F.round(col(n) * F.lit(1e6) / col(fs)).cast("bigint")


def basename(path: str | Column) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def parent_name(path: str | Column) -> Column:
    return F.element_at(F.split(col(path), "/"), -2)


def stem(path: str | Column) -> Column:
    """File name up to its last dot."""
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")
