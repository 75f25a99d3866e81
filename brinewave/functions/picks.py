"""Expressions on the pick list of a manifest row.

``picks`` is ARRAY<STRUCT<offset_s, n_annotators, copies>>. Offsets are kept to
one decimal, so a list is no longer than the tenths of a second in a segment
times the distinct annotator counts, whatever number of raw annotations fell
into it; ``copies`` says how many.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brinewave.functions.timing import col


def quorum(label: Column, picks: Column, minimum: int) -> Column:
    """Offsets confirmed by enough annotators; lists of negative rows stay as they are."""
    kept = F.filter(picks, lambda p: p["n_annotators"] >= minimum)
    return F.transform(F.when(label == "positive", kept).otherwise(picks), lambda p: p["offset_s"])


def relabel(label: Column, offsets: Column) -> Column:
    return F.when(F.size(offsets) == 0, F.lit("negative")).otherwise(label)


def all_counts_equal(picks: Column, n: int) -> Column:
    """True on an empty list."""
    return F.forall(picks, lambda p: p["n_annotators"] == n)


def label_number(text: str | Column) -> Column:
    return (~F.contains(col(text), F.lit("negative"))).cast("int")
