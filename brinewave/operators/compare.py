"""Results of several models side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missed(results: DataFrame, threshold: float = 0.5, include_undetected: bool = False) -> DataFrame:
    """Missed positives in ``results(model, kind, dataset, seg_id, truth, score)``.

    A segmenter misses a detected segment scored below the threshold (and, on
    request, one without any detection); a classifier one not above it.
    """
    low = F.col("score") < threshold
    if include_undetected:
        low = F.coalesce(low, F.lit(True))
    not_above = F.coalesce(F.col("score") <= threshold, F.lit(False))
    miss = F.when(F.col("kind") == "segmenter", low).otherwise(not_above)
    return results.where((F.col("truth") == 1) & miss)


def missed_by_all(results: DataFrame, n_models: int, **kw) -> DataFrame:
    """(dataset, seg_id) of the segments every model missed."""
    return (
        missed(results, **kw)
        .groupBy("dataset", "seg_id")
        .agg(F.countDistinct("model").alias("n"))
        .where(F.col("n") == n_models)
        .select("dataset", "seg_id")
    )


def roc_report(points: DataFrame, models: list[str], rate: str = "tpr") -> DataFrame:
    """One column per model, one row per (dataset, quorum, threshold)."""
    return points.groupBy("dataset", "min_annot", "thr").pivot("model", models).agg(F.first(rate))


def union_datasets(named: dict[str, DataFrame]) -> DataFrame:
    """Bag union of manifests or results with the name of the data set each row came from."""
    tagged = [df.withColumn("dataset", F.lit(name)) for name, df in named.items()]
    return reduce(DataFrame.unionByName, tagged)
