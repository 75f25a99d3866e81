"""Scores of a segmenter and of a classifier over a labelled set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewave.functions.curves import find_peaks, objective_curve, peak_seconds, unnest
from brinewave.functions.picks import quorum, relabel
from brinewave.operators import matching, scoring, training
from brinewave.session import cut_lineage

# Evaluation settings
MIN_HEIGHT = 0.0005
TOLERANCE_S = 10.0


def positions(curves: DataFrame, curve: str, step_s: float, height: float, tolerance_s: float) -> DataFrame:
    """``(seg_id, pos, height)`` of the peaks of a curve column."""
    found = curves.withColumn(
        "_peaks", peak_seconds(find_peaks(curve, height, tolerance_s / step_s), step_s)
    )
    each = unnest(found, ["seg_id"], "_peaks", "_i", "_p")
    return each.select("seg_id", F.col("_p.pos_s").alias("pos"), F.col("_p.h").alias("height"))


def evaluate_segmenter(
    rows: DataFrame,
    prediction: Column,
    steps: int,
    duration_s: float = 100.0,
    width_s: float = 10.0,
    min_annotators: int = 1,
    tolerance_s: float = TOLERANCE_S,
    min_height: float = MIN_HEIGHT,
    histogram_step_s: float | None = None,
) -> dict[str, DataFrame]:
    """Peaks, matches, outcomes, ROC, histogram and loss of predicted curves.

    ``rows(seg_id, label, picks, ...)``; ``prediction`` gives the curve of
    ``steps`` values. Curves are predicted once and checkpointed, as every
    result reads them. Truth positions are detected on the objective curve
    itself, so they are on its time grid.
    """
    step_s = duration_s / steps
    offsets = quorum(F.col("label"), F.col("picks"), min_annotators)
    curves = cut_lineage(
        rows.select(
            "seg_id",
            objective_curve(offsets, steps, duration_s, width_s).alias("y"),
            prediction.cast("array<double>").alias("p"),
        )
    )
    detections = positions(curves, "p", step_s, min_height, tolerance_s)
    truths = positions(curves, "y", step_s, min_height, tolerance_s)
    matched = matching.nearest_truth(detections, truths, ["seg_id"], tolerance_s)
    hits = matching.true_peaks(matched, ["seg_id"])
    outcomes = matching.segment_outcomes(curves, truths, detections, ["seg_id"])
    bar = histogram_step_s or 2 * step_s
    return {
        "counts": scoring.detection_counts(detections, truths),
        "scores": scoring.curve_scores(curves, "y", "p"),
        "true_peaks": hits,
        "peak_scores": matching.peak_scores(matched, ["seg_id"]),
        "outcomes": outcomes,
        "totals": matching.outcome_totals(outcomes),
        "roc": scoring.roc_points(outcomes),
        "residuals": scoring.residual_histogram(hits, tolerance_s, bar),
    }


def evaluate_classifier(
    rows: DataFrame, model, array: str = "share", min_annotators: int = 1
) -> dict[str, DataFrame]:
    """AUC, outcome per id and ROC of a tree model.

    ``rows(seg_id, label, picks, <array>)`` already joined by key, so an id
    always belongs to its own vector.
    """
    offsets = quorum(F.col("label"), F.col("picks"), min_annotators)
    named = relabel(F.col("label"), offsets)
    truth = F.when(named == "positive", 1).otherwise(0)
    ready = rows.where(F.col(array).isNotNull()).select("seg_id", truth.alias("truth"), array)
    scored = training.score_trees(model, ready, array).select("seg_id", "truth", "score")
    return {
        "scored": scored,
        "auc": scoring.auc_exact(scored, "score", "truth"),
        "confusion": scoring.confusion(scored, "score", "truth").where("outcome <> 'TN'"),
        "roc": scoring.roc_points(scored),
    }
