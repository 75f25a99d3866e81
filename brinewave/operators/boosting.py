"""Gradient-boosted trees by histograms, many models (folds x trials) in one pass over the rows.

Features are binned once, at quantiles of all rows, into one byte each; rows are packed into
blocks. A tree grows level by level: every block gives, for each model and node, the sums of
gradients and curvatures per feature and bin; the sums are added by model across the
cluster and reduced there to the best split of each node. Only splits reach the driver: a level
of a tree is one job whatever the number of models, and what it returns does not depend on
the number of rows. Sums are exchanged once a partition and model, so blocks are packed into
partitions of ``PART_BLOCKS`` full blocks, however finely the rows came; where these are fewer than
twice the cores, the models are dealt out to teams, each of which has the partitions for itself. A table of
one partition needs no exchange. Blocks carry the margins of their team's models; they are persisted
per round and checkpointed every ``CHECKPOINT_EVERY`` rounds, so a lost executor costs those rounds.

Rows that fit one block need no exchange of sums: a task then grows a whole model by the same
functions, one task per model (``alone``). The block is broadcast, ``BLOCK_ROWS`` rows of one
byte per feature at most.

Defined cases: a missing feature counts as smaller than all values; a vector that is shorter
than the longest is missing the rest; rows without a label are left out; a training part of
one class, or without a permitted split, scores its share; no rows give no models.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from brinewave.session import checkpoint_folder, cut_lineage

#: rows of a block
BLOCK_ROWS = 1 << 16
#: full blocks of a partition
PART_BLOCKS = 4
BINS = 255
# Defaults of histogram boosting
MIN_ROWS, MIN_CURVATURE = 20, 1e-3
PATIENCE, TOLERANCE, STOP_SHARE, STOP_FROM_ROWS = 10, 1e-7, 0.1, 10_000
CHECKPOINT_EVERY = 50


@dataclass(frozen=True)
class Spec:
    """One model: trees at most, learning rate, the fold it does not see, and whether it may stop early."""

    model: int
    trees: int
    rate: float
    fold: int | None = None
    depth: int = 4
    stop_early: bool = False


@dataclass
class Block:
    """Packed rows: bin codes, label, fold (-1 without one), stopping part, key."""

    codes: np.ndarray
    label: np.ndarray
    fold: np.ndarray
    stopping: np.ndarray
    key: np.ndarray

    def trains(self, spec: Spec) -> np.ndarray:
        seen = self.fold != spec.fold if spec.fold is not None else np.ones(len(self.fold), bool)
        return seen & ~self.stopping if spec.stop_early else seen

    def stops(self, spec: Spec) -> np.ndarray:
        seen = self.fold != spec.fold if spec.fold is not None else np.ones(len(self.fold), bool)
        return seen & self.stopping


Level = tuple[np.ndarray, np.ndarray]  # feature (-1: no split) and highest bin that goes left, per node


def node_of(codes: np.ndarray, levels: list[Level]) -> np.ndarray:
    """Node of each row below the given levels of a tree."""
    node, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
    for feature, top in levels:
        f = feature[node]
        node = 2 * node + ((f >= 0) & (codes[rows, f] > top[node]))
    return node


def histogram(cells: np.ndarray, node: np.ndarray, label: np.ndarray, margin: np.ndarray, n_nodes: int, n_cells: int) -> np.ndarray:
    """Sums of gradient, curvature and rows per node and cell; ``cells`` numbers (feature, bin) per row and feature."""
    p = 1 / (1 + np.exp(-margin))
    at = (cells + (node * n_cells)[:, None]).ravel()
    width = cells.shape[1]
    total = n_nodes * n_cells
    out = np.empty((3, total))
    out[0] = np.bincount(at, np.repeat(p - label, width), total)
    out[1] = np.bincount(at, np.repeat(p * (1 - p), width), total)
    out[2] = np.bincount(at, minlength=total)
    return out.reshape(3, n_nodes, -1)


def best_splits(sums: np.ndarray, features: int, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, highest bin on the left, values of the two sides) of each node."""
    sums = sums.reshape(3, sums.shape[1], features, -1)
    nodes, bins = sums.shape[1], sums.shape[3]
    feature, top, sides = np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros((nodes, 2))
    whole = sums[:, :, 0].sum(axis=2)
    has = whole[1] > 0
    sides[has, 0] = -rate * whole[0][has] / whole[1][has]
    # nodes too small for two permitted sides are leaves
    large = np.flatnonzero((whole[2] >= 2 * MIN_ROWS) & (whole[1] >= 2 * MIN_CURVATURE))
    if len(large) == 0 or bins < 2:
        return feature, top, sides
    g, h, n = sums[:, large].cumsum(axis=3)[..., :-1]
    all_g, all_h, all_n = (w[large][:, None, None] for w in whole)
    fits = (n >= MIN_ROWS) & (n <= all_n - MIN_ROWS) & (h >= MIN_CURVATURE) & (all_h - h >= MIN_CURVATURE)
    node = np.nonzero(fits)[0]
    gl, hl = g[fits], h[fits]
    gr, hr = whole[0][large][node] - gl, whole[1][large][node] - hl
    gain = np.full(fits.shape, -np.inf)
    gain[fits] = gl * gl / hl + gr * gr / hr
    flat = gain.reshape(len(large), -1)
    best = flat.argmax(axis=1)
    found = flat[np.arange(len(large)), best] > whole[0][large] ** 2 / whole[1][large]
    for i in np.flatnonzero(found):
        k, (f, b) = large[i], divmod(int(best[i]), bins - 1)
        feature[k], top[k] = f, b
        sides[k] = -rate * g[i, f, b] / h[i, f, b], -rate * (whole[0][k] - g[i, f, b]) / (whole[1][k] - h[i, f, b])
    return feature, top, sides


def loss(label: np.ndarray, margin: np.ndarray) -> float:
    return float(np.sum(np.logaddexp(0, margin) - label * margin))


def has_stalled(losses: list[float]) -> bool:
    """No loss of the last rounds is lower than the one before them."""
    return len(losses) > PATIENCE and min(losses[-PATIENCE:]) >= losses[-PATIENCE - 1] - TOLERANCE


def prior(positives: float, rows: float) -> float:
    share = min(max(positives / rows if rows else 0.5, 1e-7), 1 - 1e-7)
    return float(np.log(share / (1 - share)))


@dataclass
class Trees:
    """Complete binary trees of one depth: splits by level order, values of the leaves."""

    start: float
    depth: int
    feature: list[np.ndarray] = field(default_factory=list)
    top: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def add(self, levels: list[Level], sides: np.ndarray) -> None:
        self.feature.append(np.concatenate([f for f, _ in levels]).astype(np.int32))
        self.top.append(np.concatenate([t for _, t in levels]).astype(np.int32))
        self.value.append(sides.reshape(-1))

    def levels(self, k: int) -> list[Level]:
        return [(self.feature[k][2**d - 1 : 2 ** (d + 1) - 1], self.top[k][2**d - 1 : 2 ** (d + 1) - 1]) for d in range(self.depth)]

    def margin(self, codes: np.ndarray) -> np.ndarray:
        out = np.full(len(codes), self.start)
        for k in range(len(self.value)):
            out += self.value[k][node_of(codes, self.levels(k))]
        return out

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, start=self.start, depth=self.depth, feature=np.array(self.feature, np.int32), top=np.array(self.top, np.int32), value=np.array(self.value))
        return out.getvalue()

    @staticmethod
    def unpack(data: bytes) -> Trees:
        got = np.load(io.BytesIO(data))
        return Trees(float(got["start"]), int(got["depth"]), list(got["feature"]), list(got["top"]), list(got["value"]))


@dataclass
class Model:
    """Trees and the upper edges of the bins of every feature."""

    trees: Trees
    edges: list[np.ndarray]

    def score(self, rows: DataFrame, array: str, name: str = "score") -> DataFrame:
        """``rows`` with the probability of label 1."""
        at = rows.columns.index(array)
        model = rows.sparkSession.sparkContext.broadcast((self.trees.pack(), self.edges))  # bounded by trees and bins
        schema = StructType([*rows.schema.fields, StructField(name, DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packed, edges = model.value
            trees = Trees.unpack(packed)
            for batch in batches:
                margin = trees.margin(bin_codes(batch.column(at), edges))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-margin)))], schema.names)

        return rows.mapInArrow(run, schema)


def bin_edges(rows: DataFrame, array: str) -> list[np.ndarray]:
    """Upper edges of the bins of each feature: at most ``BINS`` quantiles of all rows."""
    size = rows.agg(F.max(F.size(array)).alias("n")).first()["n"]
    shares = [i / BINS for i in range(1, BINS)]
    edges = []
    for start in range(0, size or 0, 64):  # sketches of 64 features at a time
        value = lambda i: F.get(F.col(array), F.lit(i)).cast("double")
        wanted = range(start, min(start + 64, size))
        quantiles = [F.percentile_approx(F.when(~F.isnan(value(i)), value(i)), shares, 10 * BINS).alias(f"q{i}") for i in wanted]
        found = rows.agg(*quantiles).first()
        edges += [np.unique(np.array(found[f"q{i}"] or [], np.float64)) for i in wanted]
    return edges


def bin_codes(column: pa.Array, edges: list[np.ndarray]) -> np.ndarray:
    """One byte per feature: how many edges a value exceeds; a missing value is 0."""
    out = np.zeros((len(column), len(edges)), np.uint8)
    sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    first = np.cumsum(sizes) - sizes
    for i, edge in enumerate(edges):
        has = sizes > i
        x = flat[first[has] + i]
        out[has, i] = np.where(np.isnan(x), 0, np.searchsorted(edge, x, side="left"))
    return out


def packed_blocks(rows: DataFrame, array: str, label: str, key: str, fold: str | None, edges: list[np.ndarray], block_rows: int) -> DataFrame:
    """Rows as blocks of bytes, a table that every round reads; the stopping part is told by a hash of the key."""
    stop = F.pmod(F.xxhash64(F.lit("stopping"), F.col(key).cast("string")), F.lit(1000)) < int(1000 * STOP_SHARE)
    part = F.coalesce(F.col(fold), F.lit(-1)).cast("int") if fold else F.lit(-1)
    chosen = rows.where(F.col(label).isNotNull()).select(
        F.col(array).alias("x"), F.col(label).cast("double").alias("y"), part.alias("fold"), stop.alias("stop"), F.col(key).cast("long").alias("key")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def out(parts):
            whole = [np.concatenate(c).tobytes() for c in zip(*parts)]
            return pa.RecordBatch.from_arrays([pa.array([sum(len(p[1]) for p in parts)], pa.int32()), *(pa.array([w], pa.binary()) for w in whole)], names)

        for batch in batches:
            columns = [bin_codes(batch.column(0), edges), *(batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4))]
            columns[2:] = columns[2].astype(np.int32), columns[3].astype(bool), np.nan_to_num(columns[4]).astype(np.int64)
            for start in range(0, batch.num_rows, block_rows):
                piece = [c[start : start + block_rows] for c in columns]
                if count + len(piece[1]) > block_rows and held:
                    yield out(held)
                    held, count = [], 0
                held.append(piece)
                count += len(piece[1])
        if held:
            yield out(held)

    names = ["n", "codes", "label", "fold", "stopping", "key"]
    return chosen.mapInArrow(run, "n int, codes binary, label binary, fold binary, stopping binary, key binary")


def unpack(row) -> Block:
    kinds = {"codes": np.uint8, "label": np.float64, "fold": np.int32, "stopping": bool, "key": np.int64}
    whole = {c: np.frombuffer(row[c], kind) for c, kind in kinds.items()}
    whole["codes"] = whole["codes"].reshape(row["n"], -1)
    return Block(**whole)


def cells_of(codes: np.ndarray, bins: int) -> np.ndarray:
    return codes.astype(np.int64) + np.arange(codes.shape[1]) * bins


def alone(block: Block, spec: Spec, bins: int) -> tuple[Trees, np.ndarray]:
    """A whole model on one block, and the margins of all its rows."""
    trains, stops = block.trains(spec), block.stops(spec)
    cells, label = cells_of(block.codes[trains], bins), block.label[trains]
    features = block.codes.shape[1]
    trees = Trees(prior(label.sum(), len(label)), spec.depth)
    margin = np.full(len(block.label), trees.start)
    losses = [loss(block.label[stops], margin[stops])]
    codes = block.codes[trains]
    one_class = len(label) == 0 or label.min() == label.max()
    for _ in range(0 if one_class else spec.trees):
        levels: list[Level] = []
        for d in range(spec.depth):
            sums = histogram(cells, node_of(codes, levels), label, margin[trains], 2**d, features * bins)
            feature, top, sides = best_splits(sums, features, spec.rate)
            levels.append((feature, top))
        trees.add(levels, sides)
        margin += trees.value[-1][node_of(block.codes, levels)]
        if spec.stop_early:
            losses.append(loss(block.label[stops], margin[stops]))
            if has_stalled(losses):
                break
    return trees, margin


FIT = "model int, n_trees int, trees binary"
HELD = "model int, key long, label double, score double"


def held_rows(block: Block, spec: Spec, margin: np.ndarray) -> pa.RecordBatch:
    """Scores of the rows a model has not seen: those of its fold."""
    held = block.fold == spec.fold if spec.fold is not None else np.zeros(len(block.fold), bool)
    columns = np.full(held.sum(), spec.model, np.int32), block.key[held], block.label[held], 1 / (1 + np.exp(-margin[held]))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["model", "key", "label", "score"])


def fit_alone(spark: SparkSession, block: Block, specs: list[Spec], bins: int) -> tuple[DataFrame, DataFrame]:
    """``FIT`` and ``HELD`` tables, a task for each model."""
    shared = spark.sparkContext.broadcast((block, specs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, in_order = shared.value
        for batch in batches:
            for at in batch.column(0).to_pylist():
                spec = in_order[at]
                trees, margin = alone(rows, spec, bins)
                held = held_rows(rows, spec, margin).to_pylist()
                yield pa.RecordBatch.from_pylist([{"model": spec.model, "n_trees": len(trees.value), "trees": trees.pack(), "held": held}], schema)

    schema = pa.schema([("model", pa.int32()), ("n_trees", pa.int32()), ("trees", pa.binary()), ("held", pa.list_(pa.struct([("model", pa.int32()), ("key", pa.int64()), ("label", pa.float64()), ("score", pa.float64())])))])
    numbers = spark.range(0, len(specs), 1, len(specs))  # one in each partition
    fits = cut_lineage(numbers.mapInArrow(run, f"{FIT}, held array<struct<model:int,key:long,label:double,score:double>>"))
    return fits.drop("held"), fits.select(F.explode("held").alias("h")).select("h.*")


def fit_together(spark: SparkSession, blocks: DataFrame, specs: list[Spec], bins: int, features: int) -> tuple[DataFrame, DataFrame]:
    """``FIT`` and ``HELD`` tables of all models over any number of blocks, a job for each level.

    Every partition of ``blocks`` gives a part of each model's sums.
    """
    context = spark.sparkContext
    checkpoint_folder(spark)
    rows = blocks.rdd.map(unpack)
    totals = rows.flatMap(lambda b: [(s.model, np.array([b.label[t].sum(), t.sum()])) for s in specs for t in [b.trains(s)]]).reduceByKey(np.add).collectAsMap()
    trees = {s.model: Trees(prior(*totals.get(s.model, (0, 0))), s.depth) for s in specs}
    starts = {s.model: trees[s.model].start for s in specs}
    parts = rows.getNumPartitions()
    teams = min(len(specs), -(-2 * context.defaultParallelism // parts))
    dealt = [[s.model for s in specs[k::teams]] for k in range(teams)]
    state = context.union([rows.map(lambda b, mine=mine: (b, {m: np.full(len(b.label), starts[m]) for m in mine})) for mine in dealt]).persist()
    open_ = [s for s in specs if s.trees > 0 and 0 < totals[s.model][0] < totals[s.model][1]] if totals else []
    losses: dict[int, list[float]] = {s.model: [] for s in specs}
    older, done = None, 0
    while open_:
        grown: dict[int, list[Level]] = {s.model: [] for s in open_}
        sides = {}
        for d in range(max(s.depth for s in open_)):
            now = [s for s in open_ if d < s.depth]
            found = level_splits(state, now, {s.model: grown[s.model] for s in now}, d, bins, features, parts > 1)
            for s in now:
                total, feature, top, side = found[s.model]
                if d == 0 and s.stop_early:
                    losses[s.model].append(total)
                grown[s.model].append((feature, top))
                sides[s.model] = side
        # the losses are those before this tree: a model that had stalled does not get it
        open_ = [s for s in open_ if not (s.stop_early and has_stalled(losses[s.model]))]
        for s in open_:
            trees[s.model].add(grown[s.model], sides[s.model])
        step = {s.model: (grown[s.model], trees[s.model].value[-1]) for s in open_}
        open_ = [s for s in open_ if len(trees[s.model].value) < s.trees]
        following = state.map(lambda x, step=step: (x[0], advanced(x[0], x[1], step))).persist()
        done += 1
        if done % CHECKPOINT_EVERY == 0:
            following.checkpoint()
            following.count()
        if older is not None:
            older.unpersist()
        older, state = state, following
    fits = spark.createDataFrame([(m, len(t.value), t.pack()) for m, t in trees.items()], FIT)
    held = state.flatMap(lambda x: [r for s in specs if s.model in x[1] for r in held_rows(x[0], s, x[1][s.model]).to_pylist()])
    held = cut_lineage(spark.createDataFrame(held.map(lambda r: (r["model"], r["key"], r["label"], r["score"])), HELD))
    state.unpersist()
    if older is not None:
        older.unpersist()
    return fits, held


def advanced(block: Block, margins: dict[int, np.ndarray], step: dict) -> dict[int, np.ndarray]:
    """The margins after one more tree of the models in ``step``."""

    def after(model: int, margin: np.ndarray) -> np.ndarray:
        levels, value = step[model]
        return margin + value[node_of(block.codes, levels)]

    return {m: after(m, margin) if m in step else margin for m, margin in margins.items()}


def level_splits(state, specs: list[Spec], grown: dict[int, list[Level]], depth: int, bins: int, features: int, exchange: bool) -> dict:
    """model -> (loss of the stopping part, feature, top, sides) of the nodes of a level.

    Without ``exchange`` all blocks of a model are in one partition.
    """
    rates = {s.model: s.rate for s in specs}

    def sums(blocks):
        """For each model of a partition: loss, sums of gradients and curvatures, rows."""
        out: dict[int, tuple] = {}
        for block, margins in blocks:
            for s in specs:
                if s.model not in margins:
                    continue
                t, margin = block.trains(s), margins[s.model]
                codes = block.codes[t]
                part = histogram(cells_of(codes, bins), node_of(codes, grown[s.model]), block.label[t], margin[t], 2**depth, features * bins)
                stops = block.stops(s)
                found = loss(block.label[stops], margin[stops]) if depth == 0 else 0.0, part[:2], part[2].astype(np.int64)
                out[s.model] = added(out[s.model], found) if s.model in out else found
        yield from out.items()

    def added(a: tuple, b: tuple) -> tuple:
        return a[0] + b[0], a[1] + b[1], a[2] + b[2]

    def chosen(of: tuple) -> tuple:
        model, (total, curves, rows) = of
        return model, (total, *best_splits(np.concatenate([curves, rows[None]]), features, rates[model]))

    found = state.mapPartitions(sums)
    return dict((found.reduceByKey(added) if exchange else found).map(chosen).collect())


def fit_many(
    rows: DataFrame, array: str, label: str, specs: list[Spec], key: str, fold: str | None = None, block_rows: int = BLOCK_ROWS
) -> tuple[DataFrame, DataFrame, list[np.ndarray]]:
    """Fit all models at once: ``FIT`` rows, ``HELD`` rows (scores of each model's own fold), bin edges.

    ``key`` is a number unique to a row.
    """
    spark = rows.sparkSession
    edges = bin_edges(rows, array)
    bins = max([len(e) + 1 for e in edges], default=1)
    blocks = cut_lineage(packed_blocks(rows, array, label, key, fold, edges, block_rows))
    total = blocks.agg(F.sum("n").alias("n")).first()["n"] or 0
    if total == 0 or not edges:
        return spark.createDataFrame([], FIT), spark.createDataFrame([], HELD), edges
    if total <= block_rows:
        parts = [unpack(r) for r in blocks.collect()]
        order = np.argsort(np.concatenate([p.key for p in parts]), kind="stable")
        whole = {c: np.concatenate([getattr(p, c) for p in parts])[order] for c in ("codes", "label", "fold", "stopping", "key")}
        fits, held = fit_alone(spark, Block(**whole), specs, bins)
    else:
        parts = -(-total // (PART_BLOCKS * block_rows))
        fits, held = fit_together(spark, cut_lineage(blocks.repartition(parts)), specs, bins, len(edges))
    return fits, held, edges
