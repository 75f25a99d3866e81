"""Detections against truths: nearest match, peak scores, segment outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cell(x: Column, span: float) -> Column:
    return F.floor(x / F.lit(float(span))).cast("bigint")


def nearest_truth(
    detections: DataFrame,
    truths: DataFrame,
    segment: list[str],
    tolerance: float,
    span: float | None = None,
) -> DataFrame:
    """Nearest truth of every detection position, if closer than the tolerance.

    ``detections(*segment, pos, height)``, ``truths(*segment, pos)``. The earlier
    truth wins a tie. No detection x truth pairs are formed: both sides are
    merged in order and each detection looks at the truth before and after it.
    Only truths within the tolerance matter, so the merge runs per cell of a
    segment with the border truths copied to the neighbouring cell. Detections
    at one position share their fate and are collapsed first.
    """
    span = span or 4 * tolerance
    d = detections.groupBy(*segment, "pos").agg(
        F.max("height").alias("height"), F.count("*").alias("copies")
    )
    t = truths.select(*segment, "pos").distinct()
    reach = F.sequence(_cell(F.col("pos") - tolerance, span), _cell(F.col("pos") + tolerance, span))
    merged = d.select(
        *segment, _cell(F.col("pos"), span).alias("_cell"), "pos", "height", "copies",
        F.lit(None).cast(t.schema["pos"].dataType).alias("_truth"), F.lit(1).alias("_kind"),
    ).unionByName(
        t.withColumn("_cell", F.explode(reach)).select(
            *segment, "_cell", "pos", F.col("pos").alias("_truth"), F.lit(0).alias("_kind")
        ),
        allowMissingColumns=True,
    )
    cell = Window.partitionBy(*segment, "_cell")
    until_here = (Window.unboundedPreceding, Window.currentRow)
    earlier = F.last("_truth", ignorenulls=True).over(
        cell.orderBy("pos", "_kind").rowsBetween(*until_here)
    )
    later = F.last("_truth", ignorenulls=True).over(
        cell.orderBy(F.desc("pos"), "_kind").rowsBetween(*until_here)
    )
    both = merged.withColumn("_before", earlier).withColumn("_after", later).where("_kind = 1")
    take_before = F.col("_after").isNull() | (
        F.col("pos") - F.col("_before") <= F.col("_after") - F.col("pos")
    )
    nearest = F.when(F.col("_before").isNotNull() & take_before, F.col("_before")).otherwise(
        F.col("_after")
    )
    near = F.when(F.abs(F.col("pos") - nearest) < tolerance, nearest)
    return both.withColumn("truth", near).select(*segment, "pos", "height", "copies", "truth")


def true_peaks(matched: DataFrame, segment: list[str]) -> DataFrame:
    """One row per truth that was hit: its highest detection (first on a tie) and residual."""
    best = F.max(F.struct("height", (-F.col("pos")).alias("neg")))
    return (
        matched.where("truth IS NOT NULL")
        .groupBy(*segment, "truth")
        .agg(best.alias("b"), F.sum("copies").alias("n_hits"))
        .select(
            *segment,
            "truth",
            (-F.col("b.neg")).alias("pos"),
            F.col("b.height").alias("height"),
            (-F.col("b.neg") - F.col("truth")).alias("residual"),
            "n_hits",
        )
    )


def peak_scores(matched: DataFrame, segment: list[str]) -> DataFrame:
    """Detections, true and false peaks per segment; every hit but a truth's best is false."""
    per_truth = matched.groupBy(*segment, "truth").agg(F.sum("copies").alias("n"))
    return (
        per_truth.groupBy(*segment)
        .agg(
            F.sum("n").alias("n_detections"),
            F.count("truth").alias("n_true"),
        )
        .withColumn("n_false", F.col("n_detections") - F.col("n_true"))
    )


def segment_outcomes(
    segments: DataFrame, truths: DataFrame, detections: DataFrame, segment: list[str]
) -> DataFrame:
    """TP / FN / FP / TN of each segment with its best height, whatever the distance.

    The three inputs are stacked and reduced in one aggregation, so the map side
    combines all rows of a segment and a single shuffle is left.
    """
    none = F.lit(None).cast("double")
    stacked = (
        segments.select(*segment, F.lit(0).alias("t"), none.alias("h"), F.lit(1).alias("s"))
        .unionByName(truths.select(*segment, F.lit(1).alias("t"), none.alias("h"), F.lit(0).alias("s")))
        .unionByName(
            detections.select(
                *segment, F.lit(0).alias("t"), F.col("height").cast("double").alias("h"), F.lit(0).alias("s")
            )
        )
    )
    reduced = stacked.groupBy(*segment).agg(
        F.max("s").alias("s"), F.max("t").alias("truth"), F.max("h").alias("score")
    )
    outcome = (
        F.when((F.col("truth") == 1) & F.col("score").isNotNull(), "TP")
        .when(F.col("truth") == 1, "FN")
        .when(F.col("score").isNotNull(), "FP")
        .otherwise("TN")
    )
    return reduced.where("s = 1").select(*segment, "truth", "score", outcome.alias("outcome"))


def outcome_totals(outcomes: DataFrame, *by: str) -> DataFrame:
    def n(name: str) -> Column:
        return F.count_if(F.col("outcome") == name).alias(name.lower())

    return outcomes.groupBy(*by).agg(
        F.sum("truth").cast("bigint").alias("p"),
        F.sum(1 - F.col("truth")).cast("bigint").alias("n"),
        n("TP"),
        n("FN"),
        n("FP"),
        n("TN"),
    )
