"""Tree ensembles as tables of nodes, and each feature's share in each prediction (inventory M21, A16g).

The share is the Shapley value under the trees' own expectations: a feature that is
not known goes down both branches, by the rows that training sent there.  A leaf
matters to the features on its way alone, and for a row each of these either leads
to the leaf or not; so a leaf's shares are a table by these patterns, and a row
looks its pattern up.  Shares and base add up to the prediction.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from math import factorial
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import over
from ..sources.staging import shared_folder

#: Nodes of an ensemble that tasks get; a forest of 1,000 trees of depth 10 has at most two million.
MOST_NODES = 2_000_000
NODES = "tree int, id int, left int, right int, feature int, threshold double, categories array<int>, cover double, values array<double>"


@dataclass
class Tree:
    """Nodes by number, the root first: children (-1 at leaves), the split, the weight of training rows, and a value for each output."""

    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    cover: np.ndarray
    values: np.ndarray
    categories: dict[int, np.ndarray]  # of splits by category: those that go left

    def goes_left(self, node: int, x: np.ndarray) -> np.ndarray:
        value = x[:, self.feature[node]]
        return np.isin(value, self.categories[node]) if node in self.categories else value <= self.threshold[node]

    def leaves(self) -> list[list[tuple[int, bool]]]:
        """The way to each leaf: (node, left?) from the root on; the leaf is the last node's child."""
        out, stack = [], [(0, [])]
        while stack:
            node, way = stack.pop()
            if self.left[node] < 0:
                out.append((node, way))
            else:
                stack += [(int(self.right[node]), [*way, (node, False)]), (int(self.left[node]), [*way, (node, True)])]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        todo = np.flatnonzero(self.left[at] >= 0)
        while len(todo):
            for node in np.unique(at[todo]):
                rows = todo[at[todo] == node]
                at[rows] = np.where(self.goes_left(node, x[rows]), self.left[node], self.right[node])
            todo = todo[self.left[at[todo]] >= 0]
        return self.values[at]

    def base(self) -> np.ndarray:
        """The mean of the leaves by the training rows that reached them."""
        ends = self.left < 0
        return (self.cover[ends, None] * self.values[ends]).sum(0) / self.cover[ends].sum()


def node_table(model) -> DataFrame:
    """Rows of NODES of a fitted tree, forest or boosted trees of pyspark.ml, read from its stored form.

    Values are scaled so that the sum over trees is the prediction: a class's
    probability for forests and trees of classes, the margin for boosted classes.
    """
    spark = SparkSession.getActiveSession()
    path = f"{shared_folder(spark)}/model-{uuid4().hex}"
    model.write().overwrite().save(path)
    stored = spark.read.parquet(f"{path}/data")
    if "treeID" in stored.columns:
        stored = stored.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        stored = stored.withColumn("tree", F.lit(0))
    boosted = type(model).__name__.startswith("GBT")
    by_class = hasattr(model, "numClasses") and not boosted
    n = len(model.trees) if hasattr(model, "trees") else 1
    scale = F.element_at(F.array(*[F.lit(float(w)) for w in model.treeWeights]), F.col("tree") + 1) if boosted else F.lit(1 / n)
    total = F.aggregate("impurityStats", F.lit(0.0), lambda a, x: a + x)
    values = F.transform("impurityStats", lambda x: x / total * scale) if by_class else F.array(F.col("prediction") * scale)
    sets = F.col("split.numCategories") >= 0
    return stored.select(
        "tree", "id", F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), F.col("split.featureIndex").alias("feature"),
        F.when(~sets, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        F.when(sets, F.col("split.leftCategoriesOrThreshold").cast("array<int>")).alias("categories"),
        (total if by_class else F.element_at("impurityStats", 1)).alias("cover"), values.alias("values"),
    )


def ensemble(nodes: DataFrame) -> list[Tree]:
    """The trees of a node table; their number is bounded by MOST_NODES."""
    rows = nodes.limit(MOST_NODES + 1).toPandas()
    if len(rows) > MOST_NODES:
        raise ValueError(f"the ensemble has more than {MOST_NODES} nodes")
    out = []
    for _, own in rows.sort_values(["tree", "id"]).groupby("tree"):
        at = {int(i): k for k, i in enumerate(own.id)}
        child = lambda c: np.array([at.get(int(x), -1) for x in own[c]], np.int64)  # noqa: B023,E731
        sets = {k: np.array(c, float) for k, c in enumerate(own.categories) if c is not None and len(c)}
        out.append(Tree(child("left"), child("right"), own.feature.to_numpy(np.int64), own.threshold.to_numpy(float), own.cover.to_numpy(float), np.array(own["values"].tolist(), float), sets))
    return out


def pattern_shares(hits: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shares of the features on the way to a leaf of value 1, for rows of ``hits`` (does the feature lead there?); ``share`` of the rows goes there without it.

    The sum over all sets of known features is a polynomial in their number.
    """
    m = len(share)
    weight = np.array([factorial(s) * factorial(m - 1 - s) / factorial(m) for s in range(m)])
    out = np.empty(hits.shape)
    for i in range(m):
        poly = np.zeros((len(hits), m))
        poly[:, 0] = 1
        for j in range(m):
            if j != i:
                known = np.zeros_like(poly)
                known[:, 1:] = poly[:, :-1] * hits[:, j, None]
                poly = poly * share[j] + known
        out[:, i] = (hits[:, i] - share[i]) * (poly @ weight)
    return out


def shares(trees: Sequence[Tree], x: np.ndarray) -> np.ndarray:
    """Shares of all features: rows x outputs x features."""
    out = np.zeros((len(x), trees[0].values.shape[1], x.shape[1]))
    for tree in trees:
        left = {}
        for leaf, way in tree.leaves():
            lead: dict[int, np.ndarray] = {}
            part: dict[int, float] = {}
            for node, is_left in way:
                if node not in left:
                    left[node] = tree.goes_left(node, x)
                f = int(tree.feature[node])
                child = tree.left[node] if is_left else tree.right[node]
                here = left[node] if is_left else ~left[node]
                lead[f] = lead[f] & here if f in lead else here
                part[f] = part.get(f, 1.0) * tree.cover[child] / tree.cover[node]
            if lead:
                names = list(lead)
                hits = np.stack([lead[f] for f in names], 1)
                kinds, which = np.unique(hits, axis=0, return_inverse=True)
                found = pattern_shares(kinds.astype(float), np.array([part[f] for f in names]))[which.ravel()]
                out[:, :, names] += found[:, None, :] * tree.values[leaf][None, :, None]
    return out


def contributions(trees: Sequence[Tree], df: DataFrame, row_id: str, features: str = "features") -> DataFrame:
    """Rows (row_id, cls, base, phi): for each output of the ensemble the mean prediction and each feature's share; base + sum(phi) is the prediction."""
    base = sum(t.base() for t in trees)
    rows = df.select(F.col(row_id).alias("id"), vector_to_array(features).alias("x"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                phi = shares(trees, x)
                n, k, m = phi.shape
                ids = part.column("id").take(pa.array(np.repeat(np.arange(n), k)))
                cells = pa.ListArray.from_arrays(pa.array(np.arange(0, n * k * m + 1, m), pa.int32()), pa.array(phi.ravel()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(k), n), pa.int32()), pa.array(np.tile(base, n)), cells], ["id", "cls", "base", "phi"])

    return rows.mapInArrow(run, f"id {df.schema[row_id].dataType.simpleString()}, cls int, base double, phi array<double>").withColumnRenamed("id", row_id)


def mean_shares(found: DataFrame, names: Sequence[str], own: str | None = None) -> DataFrame:
    """Rows (cls, feature, importance, rank): the mean size of each feature's share for each class, and with cls -1 over all classes.

    With ``own``, the column of each row's class, a class's means are over its own rows.
    """
    kept = found.where(F.col(own) == F.col("cls")) if own else found
    sized = kept.withColumn("__v", array_to_vector(F.transform("phi", F.abs)))
    by_class = sized.groupBy("cls").agg(vector_to_array(Summarizer.mean(F.col("__v"))).alias("m"))
    overall = sized.agg(vector_to_array(Summarizer.mean(F.col("__v"))).alias("m")).where("m is not null").select(F.lit(-1).alias("cls"), "m")
    labels = F.array(*[F.lit(n) for n in names])
    long_ = by_class.unionByName(overall).select("cls", F.posexplode("m").alias("i", "importance"))
    ranked = F.row_number().over(over(["cls"], [F.desc("importance"), "i"]))  # a row for each feature
    return long_.withColumn("rank", ranked).select("cls", F.element_at(labels, F.col("i") + 1).alias("feature"), "importance", "rank")
