"""Histogram boosting against a plain one, and the paths of one block and of many."""

import math
import random

import numpy as np
import pytest

from brinewave.operators import boosting as b
from brinewave.operators import training


def plain_boosting(codes, labels, trees, rate, depth):
    """Margins by definition: every split of every node tried on its rows."""
    share = sum(labels) / len(labels)
    margin = [math.log(share / (1 - share))] * len(labels)

    def grow(rows, left, g, h):
        total = -rate * sum(g[i] for i in rows) / sum(h[i] for i in rows)
        best = None
        if left:
            base = sum(g[i] for i in rows) ** 2 / sum(h[i] for i in rows)
            for f in range(len(codes[0])):
                for top in sorted({codes[i][f] for i in rows})[:-1]:
                    a, c = [i for i in rows if codes[i][f] <= top], [i for i in rows if codes[i][f] > top]
                    if min(len(a), len(c)) < b.MIN_ROWS or min(sum(h[i] for i in x) for x in (a, c)) < b.MIN_CURVATURE:
                        continue
                    gain = sum(sum(g[i] for i in x) ** 2 / sum(h[i] for i in x) for x in (a, c))
                    if gain > base and (best is None or gain > best[0] + 1e-9):
                        best = gain, a, c
        if best is None:
            for i in rows:
                margin[i] += total
            return
        grow(best[1], left - 1, g, h)
        grow(best[2], left - 1, g, h)

    for _ in range(trees):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        grow(list(range(len(labels))), depth, [x - y for x, y in zip(p, labels)], [x * (1 - x) for x in p])
    return margin


def noisy(n, seed, features=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [float(rng.randrange(12)) for _ in range(features)]
        rows.append((i, x, int(x[0] + (x[1] > 5) * x[2] + rng.gauss(0, 3) > 8), rng.choice([None, 0, 1, 2])))
    return rows


SCHEMA = "k long, x array<double>, y int, fold int"


def test_equals_plain_boosting():
    rows = noisy(160, 1)
    codes = np.array([[int(v) for v in x] for _, x, _, _ in rows], np.uint8)
    labels = np.array([y for _, _, y, _ in rows], float)
    n = len(rows)
    block = b.Block(codes, labels, np.full(n, -1, np.int32), np.zeros(n, bool), np.arange(n))
    trees, margin = b.alone(block, b.Spec(0, 4, 0.3, None, 3), 12)
    assert margin == pytest.approx(plain_boosting(codes.tolist(), labels.tolist(), 4, 0.3, 3))
    assert b.Trees.unpack(trees.pack()).margin(codes) == pytest.approx(margin)


def test_many_blocks_give_the_models_of_one(spark):
    rows = spark.createDataFrame(noisy(400, 2), SCHEMA).repartition(3)
    specs = [b.Spec(m, 25, rate, fold, 3, early) for m, (rate, fold, early) in enumerate([(0.2, 0, False), (0.5, 1, False), (0.9, 2, True), (0.3, None, True)])]
    one = b.fit_many(rows, "x", "y", specs, "k", "fold")
    many = b.fit_many(rows, "x", "y", specs, "k", "fold", block_rows=70)
    sizes = [{r.model: r.n_trees for r in got[0].collect()} for got in (one, many)]
    assert sizes[0] == sizes[1] and sizes[0][0] == 25 and sizes[0][2] < 25
    held = [{(r.model, r.key): (r.label, r.score) for r in got[1].collect()} for got in (one, many)]
    assert held[0].keys() == held[1].keys() and len(held[0]) > 200
    for k, v in held[0].items():
        assert held[1][k] == pytest.approx(v)


@pytest.mark.parametrize("block_rows, parts", [(30, 4), (100, 1)])
def test_partials_do_not_follow_the_partitions_of_the_rows(spark, monkeypatch, block_rows, parts):
    """A model's sums are exchanged once a partition: rows in 12 partitions are packed into as few as their number needs."""
    seen, fit = [], b.fit_together
    monkeypatch.setattr(b, "fit_together", lambda s, blocks, *a: seen.append(blocks.rdd.getNumPartitions()) or fit(s, blocks, *a))
    rows = spark.createDataFrame(noisy(400, 7), SCHEMA).repartition(12)
    specs = [b.Spec(m, 3, 0.3, m, 3) for m in range(3)]
    one = {(r.model, r.key): r.score for r in b.fit_many(rows, "x", "y", specs, "k", "fold")[1].collect()}
    many = {(r.model, r.key): r.score for r in b.fit_many(rows, "x", "y", specs, "k", "fold", block_rows=block_rows)[1].collect()}
    assert seen == [parts] and many == pytest.approx(one)


def test_checkpointed_rounds(spark, monkeypatch):
    monkeypatch.setattr(b, "CHECKPOINT_EVERY", 2)
    rows = spark.createDataFrame(noisy(120, 3), SCHEMA)
    fits, _, _ = b.fit_many(rows, "x", "y", [b.Spec(0, 5, 0.3, None, 2)], "k", block_rows=50)
    assert fits.first().n_trees == 5


def test_early_stopping_ends_before_the_limit(spark):
    rows = spark.createDataFrame(noisy(300, 4), SCHEMA)
    got = training.cross_validate(rows, "x", "y", "k", 3, trees=10_000, rate=0.5, stop_early=True).collect()
    assert all(r.n_trees < 500 and r.auc > 0.6 for r in got)


def test_large_tables_stop_early_by_default(spark, monkeypatch):
    rows = spark.createDataFrame(noisy(50, 5), SCHEMA)
    assert not training.stops_early(rows, None) and training.stops_early(rows, True)
    monkeypatch.setattr(b, "STOP_FROM_ROWS", 49)
    assert training.stops_early(rows, None) and not training.stops_early(rows, False)


def test_missing_features_and_short_vectors(spark):
    rows = [(i, [None if i % 2 else 1.0, math.nan if i % 2 else 3.0] if i % 7 else [float(i)], i % 2, None) for i in range(200)]
    rows += [(900, None, 1, 0), (901, [], 0, 0), (902, [1.0, 2.0], None, 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    model = training.fit_trees(frame, "x", "y", "k", trees=20, rate=0.3)
    scored = training.score_trees(model, frame.withColumn("other", frame.y), "x").collect()
    assert len(scored) == 203 and all(0 <= r.score <= 1 for r in scored)
    assert all((r.score > 0.5) == (r.y == 1) for r in scored if r.k < 900 and r.k % 7)


def test_one_class_and_no_rows(spark):
    one = spark.createDataFrame([(i, [float(i)], 1, i % 2) for i in range(60)], SCHEMA)
    got = training.cross_validate(one, "x", "y", "k", 2, trees=5).collect()
    assert [(r.n_trees, r.auc) for r in got] == [(0, None), (0, None)]
    none = spark.createDataFrame([], SCHEMA)
    assert training.cross_validate(none, "x", "y", "k", 2).collect() == []
    assert training.score_trees(training.fit_trees(none, "x", "y", "k"), one, "x").first().score == 0.5
    trial = training.search(one, "x", "y", "k", [(0, 3, 0.1)], 2).first()
    assert trial.loss is None and trial.n_trees == 0


def test_search_scores_every_trial(spark):
    rows = spark.createDataFrame(noisy(300, 6), SCHEMA)
    found = training.search(rows, "x", "y", "k", [(0, 1, 0.01), (1, 40, 0.2)], 3)
    got = {r.trial: r for r in found.collect()}
    assert got[0].n_trees == 1 and got[1].n_trees == 40 and got[1].loss < got[0].loss
    assert training.best_trial(found).first().trial == 1
    assert training.cross_validate(rows, "x", "y", "k", 3, 40, 0.2).agg({"auc": "avg"}).first()[0] == pytest.approx(1 - got[1].loss)


def test_queries_keep_the_whole_space():
    assert training.TUNED_TREES == 2421 and training.TREE_LIMITS == (1, 10_000)
