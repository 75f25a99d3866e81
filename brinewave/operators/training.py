"""Gradient-boosted trees: fit, cross-validation, search, batch scoring."""

from __future__ import annotations

import math
import random
from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinewave.operators import boosting
from brinewave.operators.boosting import Model, Spec, Trees
from brinewave.operators.scoring import auc_exact

# Tuned parameters and the search space
TUNED_TREES = 2421
TUNED_RATE = 0.10524
DEPTH = 4
TREE_LIMITS = (1, 10_000)
RATE_LIMITS = (0.01, 1.0)


def stops_early(rows: DataFrame, wanted: bool | None) -> bool:
    """Whether fits end where the loss of a tenth kept aside stalls: by default on large tables only."""
    return rows.count() > boosting.STOP_FROM_ROWS if wanted is None else wanted


def fit_trees(
    rows: DataFrame, array: str, label: str, key: str, trees: int = TUNED_TREES, rate: float = TUNED_RATE,
    depth: int = DEPTH, stop_early: bool | None = None,
) -> Model:
    """One fit on all rows with a label; ``key`` is a number unique to a row."""
    spec = Spec(0, trees, rate, None, depth, stops_early(rows, stop_early))
    fits, _, edges = boosting.fit_many(rows, array, label, [spec], key)
    found = fits.first()
    return Model(Trees.unpack(found["trees"]) if found else Trees(0.0, depth), edges)


def score_trees(model: Model, rows: DataFrame, array: str) -> DataFrame:
    """``rows`` with the probability of label 1 as ``score``."""
    return model.score(rows, array)


def cross_validate(
    rows: DataFrame, array: str, label: str, key: str, folds: int, trees: int = TUNED_TREES, rate: float = TUNED_RATE,
    depth: int = DEPTH, stop_early: bool | None = None,
) -> DataFrame:
    """``(fold, n_trees, auc)``: a model for each fold, scored on the rows it has not seen.

    ``rows`` carries a fold column; rows without one train in all of them.
    """
    early = stops_early(rows, stop_early)
    specs = [Spec(i, trees, rate, i, depth, early) for i in range(folds)]
    return _fold_aucs(rows, array, label, key, specs).select(F.col("model").alias("fold"), "n_trees", "auc")


def _fold_aucs(rows: DataFrame, array: str, label: str, key: str, specs: list[Spec]) -> DataFrame:
    """``(model, n_trees, auc)`` of all models, which are fitted at once."""
    fits, held, _ = boosting.fit_many(rows, array, label, specs, key, "fold")
    aucs = auc_exact(held, "score", "label", by=["model"])
    return fits.select("model", "n_trees").join(aucs.select("model", "auc"), "model", "left")


def draw_trials(n: int, seed: int = 0, trees=TREE_LIMITS, rates=RATE_LIMITS) -> list[tuple[int, int, float]]:
    """(trial, trees, rate): trees uniform, rate log-uniform."""
    rng = random.Random(seed)
    low, high = math.log(rates[0]), math.log(rates[1])
    return [
        (i, int(rng.uniform(*trees)), math.exp(rng.uniform(low, high))) for i in range(n)
    ]


def search(
    rows: DataFrame, array: str, label: str, key: str, trials: list[tuple[int, int, float]], folds: int,
    depth: int = DEPTH, stop_early: bool | None = None,
) -> DataFrame:
    """Trial table ``(trial, trees, rate, n_trees, loss)`` with loss = 1 - mean AUC.

    Folds of all trials are fitted at once; ``n_trees`` is the largest number a fold took.
    A fold whose held rows have one class has no AUC and is left out of the mean.
    """
    early = stops_early(rows, stop_early)
    specs = [Spec(t * folds + i, trees, rate, i, depth, early) for t, trees, rate in trials for i in range(folds)]
    found = _fold_aucs(rows, array, label, key, specs).withColumn("trial", (F.col("model") / folds).cast("int"))
    means = found.groupBy("trial").agg(F.max("n_trees").alias("n_trees"), (1 - F.avg("auc")).alias("loss"))
    drawn = rows.sparkSession.createDataFrame(trials, "trial int, trees int, rate double")
    return drawn.join(means, "trial", "left").select("trial", "trees", "rate", "n_trees", "loss")


def best_trial(trials: DataFrame) -> DataFrame:
    low = F.min(F.struct(F.col("loss").isNull(), "loss", "trial", "trees", "rate"))
    return trials.agg(low.alias("b")).select("b.trial", "b.trees", "b.rate", "b.loss")


def batch_predict(
    make_predictor: Callable, column: Column, n_values: int, batch_size: int = 64, curve: bool = False
) -> Column:
    """Score arrays with a supplied predictor: one number, or one curve, per row."""
    udf = predict_batch_udf(
        make_predictor,
        return_type=T.ArrayType(T.FloatType()) if curve else T.DoubleType(),
        batch_size=batch_size,
        input_tensor_shapes=[[n_values]],
    )
    return udf(column)
