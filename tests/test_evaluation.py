import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brinewave.operators import compare, folds, history, matching, scoring

DET = "seg int, pos double, height double"
TRU = "seg int, pos double"


def plain_scores(truths, dets, tol):
    """Per segment {truth: (height, residual)} and the number of false detections."""
    hits, false = {}, {}
    for s in {d[0] for d in dets}:
        tt = sorted(p for q, p in truths if q == s)
        for _, pos, h in sorted(d for d in dets if d[0] == s):
            near = min(tt, key=lambda t: (abs(pos - t), t), default=None)
            if near is None or abs(pos - near) >= tol:
                false[s] = false.get(s, 0) + 1
                continue
            old = hits.get((s, near))
            if old is not None:
                false[s] = false.get(s, 0) + 1
            if old is None or h > old[0]:
                hits[(s, near)] = (h, pos - near)
    return hits, false


def check_match(spark, truths, dets, tol, span=None):
    m = matching.nearest_truth(
        spark.createDataFrame(dets, DET), spark.createDataFrame(truths, TRU), ["seg"], tol, span
    )
    hits, false = plain_scores(truths, dets, tol)
    got = {(r.seg, r.truth): (r.height, r.residual) for r in matching.true_peaks(m, ["seg"]).collect()}
    assert got == hits
    scores = {r.seg: r for r in matching.peak_scores(m, ["seg"]).collect()}
    for s, r in scores.items():
        assert r.n_false == false.get(s, 0)
        assert r.n_detections == sum(1 for d in dets if d[0] == s)


def test_match_by_hand(spark):
    truths = [(1, 10.0), (1, 30.0), (2, 50.0)]
    dets = [
        (1, 20.0, 0.9),  # equally far from both and exactly at the tolerance: no match
        (1, 9.0, 0.5),
        (1, 11.0, 0.5),  # same height on the same truth: the first stays
        (1, 31.0, 0.2),
        (1, 29.0, 0.3),
        (3, 5.0, 0.4),  # segment without truth
    ]
    check_match(spark, truths, dets, 10.0)
    check_match(spark, [(1, 10.0), (1, 20.0)], [(1, 15.0, 0.5)], 6.0)


@pytest.mark.parametrize("span", [None, 7.0, 1000.0])
def test_match_at_random(spark, span):
    rng = random.Random(8)
    truths = list({(rng.randrange(5), float(rng.randrange(200))) for _ in range(60)})
    dets = [(rng.randrange(6), float(rng.randrange(200)), rng.randrange(5) / 5) for _ in range(300)]
    check_match(spark, truths, dets, 6.0, span)


def outcome_frame(spark, rows):
    return spark.createDataFrame(rows, "seg int, truth int, score double")


def test_segment_outcomes(spark):
    segs = spark.createDataFrame([(i,) for i in range(5)], "seg int")
    truths = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 1.0)], TRU)
    dets = spark.createDataFrame([(0, 90.0, 0.2), (0, 91.0, 0.7), (2, 1.0, 0.4), (9, 1.0, 0.4)], DET)
    out = matching.segment_outcomes(segs, truths, dets, ["seg"])
    got = {r.seg: (r.outcome, r.score) for r in out.collect()}
    assert got == {0: ("TP", 0.7), 1: ("FN", None), 2: ("FP", 0.4), 3: ("TN", None), 4: ("TN", None)}
    t = matching.outcome_totals(out).first()
    assert t.tp + t.fn == t.p and t.fp + t.tn == t.n


def test_roc_against_counting(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(2), rng.choice([None, rng.random(), rng.randrange(1001) * 0.001, 1.2])) for i in range(500)]
    got = {r.thr: r for r in scoring.roc_points(outcome_frame(spark, rows)).collect()}
    pos = np.array([s for _, t, s in rows if t == 1 and s is not None])
    neg = np.array([s for _, t, s in rows if t == 0 and s is not None])
    n_pos = sum(t for _, t, _ in rows)
    assert sorted(got) == list(range(1001))
    for i in range(1001):
        assert got[i].tp == np.count_nonzero(pos > i * 0.001)
        assert got[i].fp == np.count_nonzero(neg > i * 0.001)
        assert got[i].tpr == pytest.approx(got[i].tp / n_pos)


def test_roc_without_positives_is_null(spark):
    got = scoring.roc_points(outcome_frame(spark, [(1, 0, 0.5)]), delta=0.5, steps=2).orderBy("thr").collect()
    assert [(r.tpr, r.fpr) for r in got] == [(None, 1.0), (None, 0.0), (None, 0.0)]


@settings(max_examples=40, deadline=None)
@given(st.floats(0, 1.5, allow_nan=False), st.sampled_from([0.001, 0.01, 0.1]))
def test_threshold_count_is_strict(spark, score, delta):
    got = spark.createDataFrame([(score,)], "s double").select(scoring.threshold_count(F.col("s"), delta)).first()[0]
    assert got == sum(1 for i in range(int(1.6 / delta) + 2) if score > i * delta)


def plain_auc(rows):
    pos = [s for _, t, s in rows if t == 1]
    neg = [s for _, t, s in rows if t == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_exact_and_bucketed(spark):
    rng = random.Random(6)
    rows = [(i, t, min(1.0, max(0.0, rng.gauss(0.4 + 0.2 * t, 0.2)))) for i in range(400) for t in [rng.randrange(2)]]
    df = outcome_frame(spark, rows)
    r = scoring.auc_exact(df).first()
    assert r.auc == pytest.approx(plain_auc(rows))
    assert scoring.auc_exact(outcome_frame(spark, [(1, 1, 0.5)])).first().auc is None
    parts = scoring.auc_counts(df.where("seg < 150")).union(scoring.auc_counts(df.where("seg >= 150")))
    assert scoring.auc_from_counts(parts).first().auc == pytest.approx(plain_auc(rows), abs=0.01)


def test_auc_exact_by_group(spark):
    rng = random.Random(7)
    values = [0.0, -0.0, 1e-300, -1e-300, 0.1, 0.1 + 1e-17, 0.5, 1e300, -1e300, -2.5, float("inf"), 0.1000000001, None]
    rows = [(g, t, rng.choice(values)) for g in range(3) for _ in range(120) for t in [rng.randrange(2)]] + [(4, 1, 0.3), (None, 0, 0.1), (None, 1, 0.2)]
    df = spark.createDataFrame(rows, "g int, truth int, score double")
    got = {r.g: r for r in scoring.auc_exact(df, by=["g"]).collect()}
    for g in range(3):
        mine = [(g, t, float("-inf") if s is None else s) for x, t, s in rows if x == g]
        assert got[g].auc == pytest.approx(plain_auc(mine))
    assert got[4].auc is None and got[4].n_pos == 1 and got[None].auc == 1.0
    empty = scoring.auc_exact(df.where("g = 99")).first()
    assert empty.auc is None


def test_histogram_borders(spark):
    low, n = scoring.histogram_grid(10, 2 * 100 / 186)
    assert n == 19 and low == pytest.approx(-9.677, abs=1e-3)
    assert scoring.histogram_grid(10, 1) == (-10, 21)
    residuals = [0.5, -10.0, -10.9, -11.1, 11.0, 11.01]
    df = spark.createDataFrame([(r,) for r in residuals], "residual double")
    got = {r.residual: r.n for r in scoring.residual_histogram(df, 10, 1).collect() if r.n}
    assert got == {0.0: 1, -10.0: 2, 10.0: 1}
    shares = [r.share for r in scoring.residual_histogram(df, 10, 1).collect()]
    assert len(shares) == 21 and sum(shares) == pytest.approx(4 / 6)


def test_curve_scores(spark):
    y = [[0.0, 1.0, 0.0], [0.0, 0.0, 0.0], [0.0, 0.5, 0.2]]
    p = [[0.1, 0.9, 0.0], [0.2, 0.7, 0.1], [0.3, 0.5, 1.0]]
    r = scoring.curve_scores(spark.createDataFrame(list(zip(y, p)), "y array<double>, p array<double>"), "y", "p").first()
    q = np.clip(np.array(p), 1e-7, 1 - 1e-7)
    t = np.array(y)
    assert r.loss == pytest.approx(np.mean(-(t * np.log(q) + (1 - t) * np.log(1 - q))))
    assert r.accuracy == pytest.approx(1 / 3)


@pytest.mark.parametrize("n_pos,n_neg", [(10, 17), (7, 30), (12, 4)])
def test_folds_are_slices(spark, n_pos, n_neg):
    rows = [(i, int(i < n_pos)) for i in range(n_pos + n_neg)]
    got = folds.assign_folds(spark.createDataFrame(rows, "id int, y int"), "id", "y", 5).collect()
    for label, n in ((1, n_pos), (0, n_neg)):
        mine = {r["rank"]: r.fold for r in got if r.y == label}
        assert sorted(mine) == list(range(n))
        for i in range(5):
            inside = set(range(int(n_pos * i / 5), int(n_pos * (i + 1) / 5))) & set(range(n))
            assert {k for k, f in mine.items() if f == i} == inside
        assert all(f is None for k, f in mine.items() if k >= n_pos)


def test_pooled_folds(spark):
    rows = [(i, int(i < 10)) for i in range(37)]
    got = folds.assign_pooled_folds(spark.createDataFrame(rows, "id int, y int"), "id", "y", 4).collect()
    pooled = [r for r in got if r.pooled]
    assert len(pooled) == 20 and sum(r.y for r in pooled) == 10
    sizes = [sum(1 for r in pooled if r.fold == i) for i in range(4)]
    assert sizes == [5, 5, 5, 5] and all(r.fold is None for r in got if not r.pooled)


def test_history(spark):
    rows = [(0, 0, "val_auc", 0.5), (0, 1, "val_auc", 0.9), (1, 0, "val_auc_2", 0.7), (1, 1, "val_auc_2", 0.9),
            (1, 1, "val_auc", 0.1), (0, 0, "loss", 9.0), (0, 2, "val_auc", 0.9)]
    df = spark.createDataFrame(rows, "fold int, epoch int, metric string, value double")
    curve = history.epoch_curve(df, "val_auc")
    assert {r.epoch: round(r.mean_value, 6) for r in curve.collect()} == {0: 0.6, 1: 0.9, 2: 0.9}
    assert history.best_epoch(curve).first().epoch == 1


def test_missed_by_all(spark):
    rows = [("a", "segmenter", "d", 1, 1, 0.4), ("b", "classifier", "d", 1, 1, 0.5), ("a", "segmenter", "d", 2, 1, None),
            ("b", "classifier", "d", 2, 1, 0.1), ("a", "segmenter", "d", 3, 0, 0.1), ("b", "classifier", "d", 3, 0, 0.1)]
    df = spark.createDataFrame(rows, "model string, kind string, dataset string, seg_id int, truth int, score double")
    assert [r.seg_id for r in compare.missed_by_all(df, 2).collect()] == [1]
    both = compare.missed_by_all(df, 2, include_undetected=True)
    assert sorted(r.seg_id for r in both.collect()) == [1, 2]
