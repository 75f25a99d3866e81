"""Seeded shuffles, samples and cross-validation folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewave.functions.hashing import seeded_key
from brinewave.operators.ordered import shuffled_rank


def fold_of_rank(rank: Column, n: Column, folds: int) -> Column:
    """Fold whose slice ``int(n*i/folds) .. int(n*(i+1)/folds)`` holds a rank, null beyond n."""
    fold = F.floor(((rank + 1) * folds + n - 1) / n).cast("int") - 1
    return F.when(rank < n, fold)


def assign_folds(rows: DataFrame, key: str, label: str, folds: int = 5, seed: int = 0) -> DataFrame:
    """Balanced folds: as many negatives as positives; surplus negatives have no fold.

    A row without a fold always trains and never validates.
    """
    positives = F.when(F.col(label) == 1, F.col("_n"))
    ranked = shuffled_rank(rows, [label], key, seed, totals={"n_pos": positives})
    return ranked.withColumn("fold", fold_of_rank(F.col("rank"), F.col("n_pos"), folds))


def assign_pooled_folds(
    rows: DataFrame, key: str, label: str, folds: int = 5, seed: int = 0
) -> DataFrame:
    """Positives and equally many negatives shuffled together, then cut into folds."""
    positives = F.when(F.col(label) == 1, F.col("_n"))
    ranked = shuffled_rank(rows, [label], key, seed, "class_rank", totals={"n_pos": positives})
    pooled = ranked.withColumn("pooled", (F.col("class_rank") < F.col("n_pos")).cast("int"))
    again = shuffled_rank(
        pooled, ["pooled"], key, seed + 1, "pool_rank",
        totals={"n_pool": F.when(F.col("pooled") == 1, F.col("_n"))},
    )
    fold = fold_of_rank(F.col("pool_rank"), F.col("n_pool"), folds)
    return again.withColumn("fold", F.when(F.col("pooled") == 1, fold)).drop("n_pos", "n_pool")


def training_part(rows: DataFrame, fold: int) -> DataFrame:
    return rows.where((F.col("fold") != fold) | F.col("fold").isNull())


def validation_part(rows: DataFrame, fold: int) -> DataFrame:
    return rows.where(F.col("fold") == fold)


def fold_sizes(rows: DataFrame, label: str, folds: int = 5) -> DataFrame:
    """Rows per fold and label on the training and on the validation side."""
    counts = rows.groupBy("fold", label).agg(F.count("*").alias("n"))
    # at most (folds + 1) x labels rows from here on
    each = counts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    inside = F.col("fold") == F.col("part")
    return each.groupBy("part", label).agg(
        F.sum(F.when(inside, F.col("n")).otherwise(0)).alias("n_valid"),
        F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("n_train"),
    )


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """First n rows of the seeded shuffle (a top-n, not a sort of the table)."""
    return rows.orderBy(seeded_key(seed, key), F.col(key)).limit(n)
