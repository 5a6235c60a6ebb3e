"""Gradient-boosted trees of several classes, of two, or of numbers (inventory M20, M25).

A level of a round's trees, one for each class, is one aggregate: tasks add up
gradients and second derivatives by node, feature and bin, Spark adds the tasks'
sums, and the driver picks the splits; what it sees is bounded by classes, nodes,
features and bins.  Scores are stored after each round.  Under the squared loss rows
of equal bins always have equal scores, so they are one row of the state.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from .trees import Tree

#: Rows of equal bins and scores: their mean label, their number, their squared deviations from it, their bins and scores.
STATE = "y double, n double, rest double, bins binary, scores array<double>"


class Growing:
    """A tree in the making: nodes with their split by bin, and the leaves of the last level."""

    def __init__(self):
        self.left, self.right, self.feature, self.bin = [-1], [-1], [-1], [-1]
        self.g, self.h = [0.0], [0.0]
        self.open = [0]

    def at(self, bins: np.ndarray) -> np.ndarray:
        """The node each row has come to."""
        where = np.zeros(len(bins), np.int64)
        left, right, feature, cut = (np.array(v) for v in (self.left, self.right, self.feature, self.bin))
        while True:
            todo = np.flatnonzero(left[where] >= 0)
            if not len(todo):
                return where
            here = where[todo]
            where[todo] = np.where(bins[todo, feature[here]] <= cut[here], left[here], right[here])

    def split(self, node: int, feature: int, cut: int, sums: tuple[float, float, float, float]) -> None:
        self.feature[node], self.bin[node] = feature, cut
        self.left[node], self.right[node] = len(self.left), len(self.left) + 1
        for g, h in (sums[:2], sums[2:]):
            self.left.append(-1)
            self.right.append(-1)
            self.feature.append(-1)
            self.bin.append(-1)
            self.g.append(g)
            self.h.append(h)

    def tree(self, cuts: Sequence[np.ndarray], output: int, outputs: int, rate: float, penalty: float) -> Tree:
        values = np.zeros((len(self.left), outputs))
        values[:, output] = -rate * np.array(self.g) / (np.array(self.h) + penalty)
        threshold = np.array([cuts[f][b] if f >= 0 else np.nan for f, b in zip(self.feature, self.bin, strict=True)])
        return Tree(np.array(self.left), np.array(self.right), np.array(self.feature), threshold, np.array(self.h), values, {})


def slopes(scores: np.ndarray, y: np.ndarray, objective: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients, second derivatives and losses of rows."""
    if objective == "softmax":
        p = np.exp(scores - scores.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        hot = np.arange(scores.shape[1]) == y[:, None]
        return p - hot, np.maximum(p * (1 - p), 1e-16), -np.log(np.maximum(p[hot], 1e-300))
    if objective == "logistic":
        p = 1 / (1 + np.exp(-scores))
        own = np.where(y[:, None] > 0, p, 1 - p)
        return p - y[:, None], np.maximum(p * (1 - p), 1e-16), -np.log(np.maximum(own[:, 0], 1e-300))
    gap = scores - y[:, None]
    return gap, np.ones_like(gap), (gap[:, 0] ** 2) / 2


def unpacked(batch: pa.RecordBatch, features: int) -> tuple[np.ndarray, ...]:
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, features)
    scores = batch.column("scores").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return bins, scores, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "n", "rest"))


def level_sums(growing: Sequence[Growing], features: int, bins: int, objective: str):
    """A task's rows (slot, feature, g, h) of the open nodes; a slot is a class's open node.  Slot -1 has the loss and the number of rows."""
    slots = [(k, node) for k, tree in enumerate(growing) for node in tree.open]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((len(slots), features * bins))
        h = np.zeros_like(g)
        loss = rows = 0
        for batch in batches:
            if batch.num_rows:
                b, scores, y, n_equal, rest = unpacked(batch, features)
                grad, hess, lost = slopes(scores, y, objective)
                grad, hess = grad * n_equal[:, None], hess * n_equal[:, None]
                loss, rows = loss + (lost * n_equal + rest / 2).sum(), rows + n_equal.sum()
                cell = b + np.arange(features) * bins
                for k, tree in enumerate(growing):
                    at = tree.at(b)
                    for s, (own, node) in enumerate(slots):
                        if own == k:
                            here = np.flatnonzero(at == node)
                            for sums, part in ((g, grad), (h, hess)):
                                sums[s] += np.bincount(cell[here].ravel(), np.repeat(part[here, k], features), features * bins)
        n = len(slots) * features
        slot = np.append(np.repeat(np.arange(len(slots)), features), -1).astype(np.int32)
        feature = np.append(np.tile(np.arange(features), len(slots)), 0).astype(np.int32)
        as_lists = lambda a, last: pa.array([*a.reshape(n, bins).tolist(), [float(last)] * bins], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(feature), as_lists(g, loss), as_lists(h, rows)], ["slot", "feature", "g", "h"])

    return run


def best_split(g: np.ndarray, h: np.ndarray, penalty: float, least: float) -> tuple[float, int, int, tuple[float, float, float, float]]:
    """(gain, feature, bin, sums) of the best split of a node's features x bins; ties go to the first."""
    gl, hl = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
    gt, ht = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
    gr, hr = gt - gl, ht - hl
    gain = gl**2 / (hl + penalty) + gr**2 / (hr + penalty) - gt**2 / (ht + penalty)
    gain = np.where((hl >= least) & (hr >= least), gain, -np.inf)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(gain[f, b]), int(f), int(b), (float(gl[f, b]), float(hl[f, b]), float(gr[f, b]), float(hr[f, b]))


def cut_points(df: DataFrame, features: str, bins: int) -> list[np.ndarray]:
    """Borders between a feature's bins, from sketches of its quantiles."""
    size = len(df.select(features).first()[0])
    grid = [i / bins for i in range(1, bins)]
    x = vector_to_array(features)
    held = df.select(x.alias("x")).agg(*[F.percentile_approx(F.when(~F.isnan(F.col("x")[i]), F.col("x")[i]), grid, 10_000) for i in range(size)]).first()
    return [np.unique(np.array(c or [0.0], float)) for c in held]


def boost(
    df: DataFrame,
    row_id: str,
    label: str,
    features: str = "features",
    objective: str = "softmax",
    rounds: int = 20,
    depth: int = 4,
    rate: float = 0.3,
    penalty: float = 1.0,
    least: float = 1.0,
    bins: int = 64,
    classes: int | None = None,
) -> tuple[list[Tree], list[float]]:
    """Trees whose values add up to the scores, and the mean loss before the first round and after each.

    ``objective`` is ``softmax`` (labels 0, 1, 2 ...; scores of all classes), ``logistic``
    (labels 0 and 1; the log-odds of 1) or ``squared`` (numbers).  Rows without a label
    are left out; values that are no number go right.
    """
    known = df.where(F.col(label).isNotNull())
    cuts = cut_points(known, features, bins)
    m, start = len(cuts), 0.0
    if objective == "softmax":
        outputs = classes or int(known.agg(F.max(label)).first()[0]) + 1
    else:
        outputs = 1
        mean = float(known.agg(F.avg(F.col(label).cast("double"))).first()[0])
        start = mean if objective == "squared" else float(np.log(max(mean, 1e-9) / max(1 - mean, 1e-9)))

    def prepare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, m)
                held = np.stack([np.searchsorted(cuts[f], x[:, f]) for f in range(m)], 1).astype(np.uint8)
                scores = [[start] * outputs] * batch.num_rows
                one, none = np.ones(batch.num_rows), np.zeros(batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(one), pa.array(none), pa.array([r.tobytes() for r in held], pa.binary()), pa.array(scores, pa.list_(pa.float64()))], ["y", "n", "rest", "bins", "scores"])

    rows = known.select(F.col(label).cast("double").alias("y"), vector_to_array(features).alias("x"))
    dealt = rows.mapInArrow(prepare, STATE)
    if objective == "squared":
        equal = dealt.groupBy("bins").agg(F.avg("y").alias("y"), F.sum("n").alias("n"), (F.var_pop("y") * F.count("y")).alias("rest"), F.first("scores").alias("scores"))
        dealt = equal.select("y", "n", "rest", "bins", "scores")
    state = staged(dealt, "boost")
    width = max(map(len, cuts)) + 1
    leaf = (np.array([v]) for v in (-1, -1, -1, np.nan, 1.0))
    forest = [Tree(*leaf, np.full((1, outputs), start), {})]
    losses = []

    def sums(growing: list[Growing]) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], float]:
        parts = state.mapInArrow(level_sums(growing, m, width, objective), "slot int, feature int, g array<double>, h array<double>")
        total = parts.select("slot", "feature", array_to_vector("g").alias("g"), array_to_vector("h").alias("h")).groupBy("slot", "feature").agg(Summarizer.sum(F.col("g")).alias("g"), Summarizer.sum(F.col("h")).alias("h"))
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        loss = 0.0
        for r in total.collect():  # a row for each class, open node and feature
            if r.slot < 0:
                loss = r.g[0] / max(r.h[0], 1)
            else:
                own = held.setdefault(r.slot, (np.zeros((m, width)), np.zeros((m, width))))
                own[0][r.feature], own[1][r.feature] = r.g.toArray(), r.h.toArray()
        return held, loss

    for _ in range(rounds):
        growing = [Growing() for _ in range(outputs)]
        for level in range(depth):
            slots = [(tree, node) for tree in growing for node in tree.open]
            if not slots:
                break
            held, loss = sums(growing)
            if level == 0:
                losses.append(loss)
            opened: dict[int, list[int]] = {id(tree): [] for tree in growing}
            for s, (tree, node) in enumerate(slots):
                g, h = held[s]
                if level == 0:
                    tree.g[0], tree.h[0] = float(g[0].sum()), float(h[0].sum())
                gain, feature, cut, parts = best_split(g, h, penalty, least)
                if gain > 1e-9 and cut < len(cuts[feature]):
                    tree.split(node, feature, cut, parts)
                    opened[id(tree)] += [tree.left[node], tree.right[node]]
            for tree in growing:
                tree.open = opened[id(tree)]
        forest += [tree.tree(cuts, k, outputs, rate, penalty) for k, tree in enumerate(growing)]
        values = [-rate * np.array(t.g) / (np.array(t.h) + penalty) for t in growing]

        def move(batches: Iterable[pa.RecordBatch], growing=growing, values=values) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    b, scores, *_ = unpacked(batch, m)
                    new = scores + np.stack([v[t.at(b)] for t, v in zip(growing, values, strict=True)], 1)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(new.tolist(), pa.list_(pa.float64()))], batch.schema.names)

        state = staged(state.mapInArrow(move, STATE), "boost")
    losses.append(sums([])[1])
    return forest, losses


def scored(trees: Sequence[Tree], df: DataFrame, row_id: str, features: str = "features", objective: str = "softmax") -> DataFrame:
    """Rows (row_id, scores, prediction): probabilities of the classes and the likeliest, or the number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                s = sum(t.predict(x) for t in trees)
                if objective == "softmax":
                    s = np.exp(s - s.max(1, keepdims=True))
                    s /= s.sum(1, keepdims=True)
                    best = s.argmax(1).astype(float)
                elif objective == "logistic":
                    s = 1 / (1 + np.exp(-s))
                    s = np.concatenate([1 - s, s], 1)
                    best = (s[:, 1] > 0.5).astype(float)
                else:
                    best = s[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(s.tolist(), pa.list_(pa.float64())), pa.array(best)], ["id", "scores", "prediction"])

    rows = df.select(F.col(row_id).alias("id"), vector_to_array(features).alias("x"))
    return rows.mapInArrow(run, f"id {df.schema[row_id].dataType.simpleString()}, scores array<double>, prediction double").withColumnRenamed("id", row_id)
