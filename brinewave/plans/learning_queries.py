"""Queries that train and apply models on the vectors of the embeddings table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brinewave.operators import folds, training
from brinewave.plans import sql, views
from brinewave.plans.registry import Tables, query
from brinewave.session import cut_lineage


FOLDS, TRIALS = 5, 10


def fold_vectors(t: Tables, n_folds: int) -> DataFrame:
    """Vectors with a binary label and folds."""
    rows = t.embeddings.select(
        "vec_id", F.col("embedding"), (F.col("label") < 5).cast("int").alias("is_low")
    )
    return folds.assign_folds(rows, "vec_id", "is_low", n_folds).select("vec_id", "embedding", "is_low", "fold")


@query("q32_gbt_cv")
def gbt_cv(t: Tables) -> DataFrame:
    """AUC of each of five folds and the mean, with the tuned number of trees."""
    rows = cut_lineage(fold_vectors(t, FOLDS))
    aucs = training.cross_validate(rows, "embedding", "is_low", "vec_id", FOLDS)
    return aucs.withColumn("mean_auc", F.avg("auc").over(Window.partitionBy(F.lit(0))))  # a row for each fold


@query("q33_search")
def random_search(t: Tables) -> DataFrame:
    """Trial table of a seeded random search of ten trials over the whole space, with the best one marked.

    A fit ends where the loss on a tenth of its rows stalls.
    """
    rows = cut_lineage(fold_vectors(t, FOLDS))
    trials = cut_lineage(training.search(rows, "embedding", "is_low", "vec_id", training.draw_trials(TRIALS, seed=0), FOLDS, stop_early=True))
    best = training.best_trial(trials)
    return trials.join(best.select("trial", F.lit(True).alias("is_best")), "trial", "left").na.fill(False)


def linear_predictor():
    weights = np.cos(np.arange(64))

    def predict(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-x.astype(np.float64) @ weights))

    return predict


@query(
    "q34_batch_score",
    sql.with_(sql.WAVE)
    + "select id as vec_id, round(1 / (1 + exp(-sum(v * cos(i)))), 6) as score from wave group by id",
)
def batch_score(t: Tables) -> DataFrame:
    score = training.batch_predict(linear_predictor, F.col("samples"), 64)
    return views.waves(t.embeddings).select("vec_id", F.round(score, 6).alias("score"))
