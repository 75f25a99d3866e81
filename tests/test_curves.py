import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinewave.functions import curves


def plain_maxima(v):
    out, i = [], 1
    while i < len(v) - 1:
        j = i
        while j + 1 < len(v) and v[j + 1] == v[i]:
            j += 1
        if v[i - 1] < v[i] and j + 1 < len(v) and v[j + 1] < v[i]:
            out.append((i + j) // 2)
        i = j + 1
    return out


def plain_apart(v, idx, gap):
    keep = []
    for i in sorted(idx, key=lambda i: (-v[i], -i)):
        if all(abs(i - k) >= gap for k in keep):
            keep.append(i)
    return sorted(keep)


def run(spark, values, expr):
    df = spark.createDataFrame([(v,) for v in values], "v array<double>")
    return [[(p.i, p.h) for p in r[0]] for r in df.select(expr).collect()]


def test_maxima_on_hand_made_curves(spark):
    cases = {
        (0.0, 1.0, 0.0): [1],
        (0.0, 1.0, 1.0, 0.0): [1],
        (0.0, 1.0, 1.0, 1.0, 0.0): [2],
        (1.0, 0.0, 1.0): [],
        (0.0, 1.0, 1.0): [],
        (1.0, 1.0, 0.0): [],
        (): [],
        (3.0,): [],
        (0.0, 1.0, 1.0, 2.0, 0.0): [3],
    }
    got = run(spark, [list(c) for c in cases], curves.local_maxima("v"))
    assert [[i for i, _ in g] for g in got] == list(cases.values())
    assert run(spark, [list(c) for c in cases], curves.find_peaks("v", 0.0)) == got


def test_peaks_against_a_plain_loop(spark):
    rng = random.Random(4)
    values = [[rng.randrange(6) / 5 for _ in range(rng.randrange(3, 120))] for _ in range(60)]
    native = curves.suppress_close(curves.at_least(curves.local_maxima("v"), 0.4), 4.2)
    for expr in (curves.find_peaks("v", 0.4, 4.2), native):
        for v, g in zip(values, run(spark, values, expr)):
            high = [i for i in plain_maxima(v) if v[i] >= 0.4]
            assert g == [(i, v[i]) for i in plain_apart(v, high, math.ceil(4.2))]


@pytest.mark.parametrize("apart,n", [(18, 1), (19, 2)])
def test_distance_is_rounded_up(spark, apart, n):
    v = [0.0] * 60
    v[10], v[10 + apart] = 1.0, 0.5
    assert len(run(spark, [v], curves.find_peaks("v", 0.1, 18.6))[0]) == n


def test_objective_curve(spark):
    df = spark.createDataFrame([([],), ([-20.0, 3.5],)], "o array<double>")
    got = [r[0] for r in df.select(curves.objective_curve("o", 186, 100.0, 10.0)).collect()]
    assert got[0] == [0.0] * 186
    step = 100 / 186
    at = [(50 + o) / step for o in (-20.0, 3.5)]
    want = np.maximum(0, 1 - np.min(np.abs(np.subtract.outer(np.arange(186), at)), axis=1) * step / 10)
    assert np.allclose(got[1], want)


def test_unnest_drops_empty_and_null(spark):
    df = spark.createDataFrame([(1, [5.0, 6.0]), (2, []), (3, None)], "k int, a array<double>")
    rows = curves.unnest(df, ["k"], "a", "i", "x").collect()
    assert [(r.k, r.i, r.x) for r in rows] == [(1, 0, 5.0), (1, 1, 6.0)]


def test_peak_seconds(spark):
    df = spark.createDataFrame([([0.0, 1.0, 0.0],)], "v array<double>")
    p = df.select(F.explode(curves.peak_seconds(curves.local_maxima("v"), 0.5)).alias("p")).first().p
    assert (p.pos_s, p.h) == (0.5, 1.0)
