"""ROC, AUC, histograms, losses and confusion lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Clip of the cross-entropy, number of thresholds of the bucketed AUC
CLIP = 1e-7
AUC_THRESHOLDS = 200


def threshold_count(score: Column, delta: float) -> Column:
    """How many of the thresholds 0, delta, 2 delta, ... a score strictly exceeds."""
    guess = F.ceil(score / F.lit(delta)).cast("bigint")
    fixed = (
        F.when(score > guess * F.lit(delta), guess + 1)
        .when(score <= (guess - 1) * F.lit(delta), guess - 1)
        .otherwise(guess)
    )
    return F.greatest(fixed, F.lit(0))


def on_grid(
    counts: DataFrame, by: list[str], index: str, size: int, amounts: list[str], first: int = 0
) -> DataFrame:
    """Counts on the full grid ``first .. first + size - 1`` of each group, 0 where nothing fell.

    ``counts`` holds at most one row per grid point and group, so a group fits
    in one map; the result has ``index``, the amounts, and ``all_<amount>``, the
    group total (rows with a null index included).
    """
    entry = F.when(F.col(index).isNotNull(), F.struct(F.col(index).cast("int"), F.struct(*amounts)))
    packed = counts.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(entry)).alias("_at"),
        *[F.sum(a).alias(f"all_{a}") for a in amounts],
    )
    points = packed.withColumn(
        index, F.explode(F.sequence(F.lit(first), F.lit(first + size - 1)))
    ).withColumn("_x", F.try_element_at("_at", F.col(index)))
    filled = [F.coalesce(F.col(f"_x.{a}"), F.lit(0)).alias(a) for a in amounts]
    return points.select(*by, index, *filled, *[f"all_{a}" for a in amounts])


def _from_top(amount: str, by: list[str], order: str) -> Column:
    """Sum over this and all higher grid points."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc(order))
    return F.sum(amount).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def roc_points(
    outcomes: DataFrame, by: list[str] | None = None, delta: float = 0.001, steps: int = 1000
) -> DataFrame:
    """Rates over the thresholds ``0..steps`` x delta from ``(truth, score)`` rows.

    Rates are over all positives / negatives, also those without a detection
    (null score). Scores are counted per bucket first: whatever the number of
    segments, at most steps + 2 rows per group are left for the running sums.
    """
    by = by or []
    # a score that exceeds b thresholds passes 0 .. b-1; -1 passes none
    last = F.least(threshold_count(F.col("score"), delta), F.lit(steps + 1)) - 1
    counts = outcomes.groupBy(*by, F.coalesce(last, F.lit(-1)).alias("thr")).agg(
        F.sum("truth").alias("p"), F.sum(1 - F.col("truth")).alias("n")
    )
    grid = on_grid(counts, by, "thr", steps + 1, ["p", "n"])
    tp, fp = _from_top("p", by, "thr"), _from_top("n", by, "thr")
    return grid.select(
        *by,
        "thr",
        tp.cast("bigint").alias("tp"),
        fp.cast("bigint").alias("fp"),
        F.when(F.col("all_p") > 0, tp / F.col("all_p")).alias("tpr"),
        F.when(F.col("all_n") > 0, fp / F.col("all_n")).alias("fpr"),
    )


#: bits of a score that one step of the exact AUC orders: a window holds at most 2**DIGIT_BITS rows
DIGIT_BITS = 16


@F.pandas_udf(LongType())
def _order_bits(score: pd.Series) -> pd.Series:
    """Whole numbers in the order of the scores: the bits of a double, those below the sign flipped where negative."""
    bits = (score.to_numpy(np.float64) + 0.0).view(np.int64)  # one zero
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFF_FFFF_FFFF_FFFF), bits))


def auc_exact(scored: DataFrame, score: str = "score", truth: str = "truth", by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by counting ordered pairs; equal scores count half.

    A null score ranks below all others. Rows without a truth are left out. With ``by``,
    one area for each group.

    Equal scores are reduced to one row by a map-side aggregation. Their bits are then
    summed up digit by digit from the right: scores that agree in all higher digits are
    one group of at most 2**16 rows, in which a running total counts the pairs, and the
    group becomes one row of the next step. No quantiles, no sort of the whole table and
    nothing written in between.
    """
    by = by or []
    value = F.coalesce(F.col(score).cast("double"), F.lit(float("-inf")))
    counts = scored.where(F.col(truth).isNotNull()).groupBy(*by, value.alias("_s")).agg(F.sum(truth).alias("p"), F.sum(1 - F.col(truth)).alias("n"))
    rows = counts.select(*by, _order_bits("_s").alias("_k"), "p", "n", (F.col("p") * F.col("n") / 2.0).alias("w"))
    sums = F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum(F.col("w") + F.col("p") * F.col("_below")).alias("w")

    def with_below(rows: DataFrame, group: list[str]) -> DataFrame:
        run = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("_below", F.coalesce(F.sum("n").over(run), F.lit(0)))

    for _ in range(64 // DIGIT_BITS - 1):
        rows = rows.withColumn("_up", F.shiftright("_k", DIGIT_BITS))
        rows = with_below(rows, [*by, "_up"]).groupBy(*by, "_up").agg(*sums).withColumnRenamed("_up", "_k")
    total = with_below(rows, by).groupBy(*by).agg(*sums)
    area = F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("w") / (F.col("p") * F.col("n")))
    return total.select(*by, area.alias("auc"), F.col("p").cast("bigint").alias("n_pos"), F.col("n").cast("bigint").alias("n_neg"))


def auc_counts(
    scored: DataFrame, score: str = "score", truth: str = "truth", weight: str | None = None,
    by: list[str] | None = None, thresholds: int = AUC_THRESHOLDS,
) -> DataFrame:
    """Weighted counts per score bucket: the mergeable state of the bucketed AUC.

    States of any number of batches or days add up; ``auc_from_counts`` reads them.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    last = F.lit(thresholds - 1.0)
    guess = F.ceil(F.col(score) * last).cast("bigint")
    # thresholds are i / (thresholds - 1); the product may round over one of them
    above = F.when(F.col(score) > guess / last, guess + 1).when(F.col(score) <= (guess - 1) / last, guess - 1).otherwise(guess)
    b = F.least(F.greatest(above - 1, F.lit(0)), F.lit(thresholds - 1)).cast("int")
    return scored.groupBy(*(by or []), b.alias("b")).agg(
        F.sum(F.when(F.col(truth) == 1, w).otherwise(0.0)).alias("p"),
        F.sum(F.when(F.col(truth) == 1, 0.0).otherwise(w)).alias("n"),
    )


def auc_from_counts(
    counts: DataFrame, by: list[str] | None = None, thresholds: int = AUC_THRESHOLDS
) -> DataFrame:
    """Trapezoid area over the thresholds of ``auc_counts`` states."""
    by = by or []
    summed = counts.groupBy(*by, "b").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    grid = on_grid(summed, by, "b", thresholds, ["p", "n"])
    rates = grid.select(
        *by,
        "b",
        F.coalesce(F.try_divide(_from_top("p", by, "b"), F.col("all_p")), F.lit(0.0)).alias("y"),
        F.coalesce(F.try_divide(_from_top("n", by, "b"), F.col("all_n")), F.lit(0.0)).alias("x"),
    )
    step = Window.partitionBy(*(by or [F.lit(0)])).orderBy("b")
    area = (F.col("x") - F.lead("x").over(step)) * (F.col("y") + F.lead("y").over(step)) / F.lit(2.0)
    return rates.withColumn("_a", area).groupBy(*by).agg(F.sum("_a").alias("auc"))


def histogram_grid(tolerance: float, step: float) -> tuple[float, int]:
    """(lowest bin center, number of bins) of a symmetric residual histogram."""
    half = round(tolerance / step)
    return -half * step, 2 * half + 1


def residual_histogram(
    true_peaks: DataFrame, tolerance: float, step: float, by: list[str] | None = None
) -> DataFrame:
    """Share of true peaks per residual bin, over *all* true peaks; empty bins are 0.

    The nearest bin is taken (lower one on a tie) and kept within one step.
    """
    by = by or []
    low, n_bins = histogram_grid(tolerance, step)
    at = F.ceil((F.col("residual") - F.lit(low)) / F.lit(float(step)) - F.lit(0.5)).cast("int")
    index = F.least(F.greatest(at, F.lit(0)), F.lit(n_bins - 1))
    center = index * F.lit(float(step)) + F.lit(low)
    kept = F.when(F.abs(F.col("residual") - center) <= F.lit(float(step)), index)
    counts = true_peaks.groupBy(*by, kept.alias("bin")).agg(F.count("*").alias("n"))
    return on_grid(counts, by, "bin", n_bins, ["n"]).select(
        *by,
        "bin",
        (F.col("bin") * F.lit(float(step)) + F.lit(low)).alias("residual"),
        "n",
        F.try_divide(F.col("n"), F.col("all_n")).alias("share"),
    )


def curve_maxima(df: DataFrame, truth_curve: str, curve: str) -> DataFrame:
    """Segmenter output as classifier output: the maximum over time of both curves."""
    return df.withColumn("truth_max", F.array_max(truth_curve)).withColumn(
        "score_max", F.array_max(curve)
    )


def cross_entropy(truth_curve: str, curve: str) -> Column:
    """Summed binary cross-entropy of one segment."""

    def loss(y: Column, raw: Column) -> Column:
        p = F.least(F.greatest(raw, F.lit(CLIP)), F.lit(1 - CLIP))
        return -(y * F.ln(p) + (1 - y) * F.ln(1 - p))

    return F.aggregate(F.zip_with(truth_curve, curve, loss), F.lit(0.0), lambda a, x: a + x)


def curve_scores(df: DataFrame, truth_curve: str, curve: str) -> DataFrame:
    """Mean cross-entropy over all steps and accuracy over all segments."""
    both = curve_maxima(df, truth_curve, curve)
    equal = (F.rint("truth_max") == F.rint("score_max")).cast("double")
    return both.agg(
        F.try_divide(F.sum(cross_entropy(truth_curve, curve)), F.sum(F.size(curve))).alias("loss"),
        F.avg(equal).alias("accuracy"),
        F.count("*").alias("n_segments"),
    )


def confusion(scored: DataFrame, probability: str, truth: str, threshold: float = 0.5) -> DataFrame:
    """Outcome at a threshold (strictly above is a detection), one row per id."""
    yes = F.col(probability) > F.lit(threshold)
    pos = F.col(truth) == 1
    name = (
        F.when(yes & pos, "TP").when(yes, "FP").when(pos, "FN").otherwise("TN")
    )
    return scored.withColumn("outcome", name)


def detection_counts(detections: DataFrame, truths: DataFrame) -> DataFrame:
    tagged = detections.select(F.lit(1).alias("d"), F.lit(0).alias("t")).unionByName(
        truths.select(F.lit(0).alias("d"), F.lit(1).alias("t"))
    )
    return tagged.agg(
        F.coalesce(F.sum("d"), F.lit(0)).alias("n_detections"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("n_truths"),
    )
