"""Training curves over folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def alias_metric(history: DataFrame, metric: str) -> DataFrame:
    """One value per (fold, epoch) for a metric, also under suffixed names like ``metric_2``.

    A suffixed name replaces the plain one; the greatest suffix wins.
    """
    preferred = F.max_by("value", F.struct((F.col("metric") != metric).alias("other"), F.col("metric")))
    return (
        history.where(F.contains(F.col("metric"), F.lit(metric)))
        .groupBy("fold", "epoch")
        .agg(preferred.alias("value"))
    )


def epoch_curve(history: DataFrame, metric: str) -> DataFrame:
    return alias_metric(history, metric).groupBy("epoch").agg(F.avg("value").alias("mean_value"))


def best_epoch(curve: DataFrame) -> DataFrame:
    """Epoch with the highest mean (first on a tie)."""
    top = F.max(F.struct("mean_value", (-F.col("epoch")).alias("e")))
    return curve.agg(top.alias("b")).select(
        (-F.col("b.e")).alias("epoch"), F.col("b.mean_value").alias("mean_value")
    )
