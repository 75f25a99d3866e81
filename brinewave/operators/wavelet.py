"""Wavelet levels and their energy share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewave.functions.kernels import level_means_column, wavelet_column


def wavelet_transform(
    segments: DataFrame,
    n_levels: int = 8,
    apply_log: bool = False,
    vmin: float | None = None,
    vmax: float | None = None,
    compat: bool = False,
) -> DataFrame:
    """Add ``levels``: [coarsest approximation, coarsest detail, ..., finest detail]."""
    bounds = [None if v is None else float(v) for v in (vmin, vmax)]
    return segments.withColumn("levels", wavelet_column(F.col("samples"), n_levels, apply_log, *bounds, compat))


def energy_share(segments: DataFrame, n_levels: int = 8) -> DataFrame:
    """Add ``share``: mean magnitude of the first n_levels arrays, summing to 1.

    The finest detail is left out. A silent segment has no shares (null).
    """
    out = segments.withColumn("_m", level_means_column(F.col("samples"), n_levels))
    total = F.aggregate("_m", F.lit(0.0), lambda s, x: s + x)
    return (
        out.withColumn("_t", total)
        .withColumn("share", F.when(F.col("_t") > 0, F.transform("_m", lambda m: m / F.col("_t"))))
        .drop("_m", "_t")
    )


def level_energy(long_levels: DataFrame, keys: list[str]) -> DataFrame:
    """Energy share from coefficients in long form ``(*keys, level, coef)``."""
    means = long_levels.groupBy(*keys, "level").agg(F.avg(F.abs("coef")).alias("mean_abs"))
    sums = means.groupBy(*keys).agg(F.sum("mean_abs").alias("_t"))
    return means.join(sums, keys).select(
        *keys, "level", F.when(F.col("_t") > 0, F.col("mean_abs") / F.col("_t")).alias("share")
    )


def aligned_scalogram(levels: str, n_levels: int) -> Column:
    """Magnitudes of all levels repeated to the length of the finest one."""
    arrays = n_levels + 1
    finest = F.size(F.element_at(levels, -1))

    def stretch(level: int) -> Column:
        times = 2 ** (arrays - 2) if level == 0 else 2 ** (arrays - level - 1)
        a = F.element_at(levels, level + 1)
        repeated = F.flatten(F.transform(a, lambda x: F.array_repeat(F.abs(x), times)))
        return F.slice(repeated, F.lit(1), finest)

    return F.array(*[stretch(level) for level in range(arrays)])
