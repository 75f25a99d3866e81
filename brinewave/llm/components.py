"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewave.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """``(v, c)`` for every vertex of ``edges(a, b)``: ``c`` is the smallest vertex it reaches.

    Each round points every vertex at its smallest neighbour, follows that pointer once
    more and contracts the graph; pointers only ever lead to smaller vertices, so the
    smallest one of a component survives. Rounds grow with the logarithm of the
    component's diameter. Every round is a written table, so a lost executor costs one
    round. A hot vertex is pre-aggregated by the grouping and split by the skewed join.
    Null ends and loops are ignored; an empty table has no components.
    """
    edges = materialise(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .where("a is not null and b is not null and a <> b")
        .distinct(),
        "edges",
    )
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("b").alias("v"), F.col("a").alias("p")).union(edges.select(F.col("a").alias("v"), F.col("a").alias("p")))
        step = materialise(both.groupBy("v").agg(F.min("p").alias("p")), "pointers")
        second = step.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        step = materialise(step.join(second, "p").select("v", F.col("pp").alias("c")), "jump")
        if labels is None:
            labels = step
        else:
            follow = step.select(F.col("v").alias("c"), F.col("c").alias("next"))
            labels = materialise(
                labels.join(follow, "c", "left").select("v", F.coalesce("next", "c").alias("c")), "labels"
            )
        to_a, to_b = step.toDF("a", "na"), step.toDF("b", "nb")
        edges = materialise(
            edges.join(to_a, "a").join(to_b, "b").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).where("a <> b").distinct(),
            "edges",
        )
    if labels is None:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("c"))
    return labels
