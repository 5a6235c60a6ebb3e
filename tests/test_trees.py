"""Shares of features against the sum over all subsets, on every kind of fitted trees."""

from itertools import chain, combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler, VectorIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from pulsemill.operators import trees


def known(tree, x, features, node=0):
    """The tree's expectation when the named features alone are known."""
    if tree.left[node] < 0:
        return tree.values[node]
    sides = (tree.left[node], tree.right[node])
    if tree.feature[node] in features:
        return known(tree, x, features, sides[0] if tree.goes_left(node, x[None])[0] else sides[1])
    return sum(tree.cover[s] / tree.cover[node] * known(tree, x, features, s) for s in sides)


def brute(forest, x):
    m = len(x)
    value = {s: sum(known(t, x, s) for t in forest) for s in chain.from_iterable(combinations(range(m), r) for r in range(m + 1))}
    out = []
    for i in range(m):
        rest = [j for j in range(m) if j != i]
        subsets = chain.from_iterable(combinations(rest, r) for r in range(m))
        out.append(sum(factorial(len(s)) * factorial(m - len(s) - 1) / factorial(m) * (value[tuple(sorted((*s, i)))] - value[s]) for s in subsets))
    return np.array(out).T  # outputs x features


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(300):
        a, b, c, d = (float(v) for v in rng.normal(0, 1, 4))
        kind = int(rng.integers(0, 4))
        rows.append((i, a, b, c, d, kind, int(a + (kind in (1, 3)) > 0) + int(b > 0.5), float(a * b + kind + 0.1 * c)))
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, kind int, label int, y double")
    x = VectorAssembler(inputCols=["a", "b", "c", "d", "kind"], outputCol="raw").transform(df)
    return VectorIndexer(inputCol="raw", outputCol="features", maxCategories=4).fit(x).transform(x).withColumn("two", (F.col("label") > 0).cast("int")).cache()


MODELS = {
    "forest": (RandomForestClassifier, dict(labelCol="label", numTrees=4, maxDepth=4, seed=1)),
    "tree": (DecisionTreeClassifier, dict(labelCol="label", maxDepth=5)),
    "boosted classes": (GBTClassifier, dict(labelCol="two", maxIter=4, maxDepth=3, seed=1)),
    "forest of numbers": (RandomForestRegressor, dict(labelCol="y", numTrees=3, maxDepth=4, seed=1)),
    "tree of numbers": (DecisionTreeRegressor, dict(labelCol="y", maxDepth=3)),
    "boosted numbers": (GBTRegressor, dict(labelCol="y", maxIter=4, maxDepth=3, seed=1)),
}


@pytest.mark.parametrize("name", MODELS)
def test_shares_against_all_subsets(table, name):
    kind, settings = MODELS[name]
    model = kind(**settings).fit(table)
    forest = trees.ensemble(trees.node_table(model))
    found = trees.contributions(forest, table, "id").collect()
    x = {r.id: np.array(r.x) for r in table.select("id", vector_to_array("features").alias("x")).collect()}
    for r in found[:60]:
        assert np.allclose(r.phi, brute(forest, x[r.id])[r.cls], atol=1e-12)
    if name == "boosted classes":
        wanted = {(r.id, 0): r.m / 2 for r in model.transform(table).select("id", (F.log(vector_to_array("probability")[1]) - F.log(vector_to_array("probability")[0])).alias("m")).collect()}
    elif "numbers" in name:
        wanted = {(r.id, 0): r.prediction for r in model.transform(table).collect()}
    else:
        wanted = {(r.id, c): p for r in model.transform(table).collect() for c, p in enumerate(r.probability)}
    assert len(found) == len(wanted)
    assert all(r.base + sum(r.phi) == pytest.approx(wanted[r.id, r.cls], abs=1e-9) for r in found)
    got = sum(t.predict(np.array(list(x.values()))) for t in forest)
    assert np.allclose(got, [[wanted[i, c] for c in range(got.shape[1])] for i in x])


def test_single_leaves_and_missing_values(table):
    flat = table.withColumn("label", F.lit(0.0)).withColumn("two", F.when(F.col("id") < 150, 0.0).otherwise(1.0))
    forest = trees.ensemble(trees.node_table(DecisionTreeRegressor(labelCol="label", maxDepth=3).fit(flat)))
    found = trees.contributions(forest, flat.limit(3), "id").collect()
    assert len(found) == 3 and all(r.base == 0 and not any(r.phi) for r in found)
    tree = trees.Tree(*(np.array(v) for v in ([1, -1, -1], [2, -1, -1], [0, -1, -1], [0.5, np.nan, np.nan], [4.0, 1.0, 3.0], [[0.0], [8.0], [4.0]])), {})
    assert np.allclose(trees.shares([tree], np.array([[np.nan], [0.0]]))[:, 0, 0], [4 - 5, 8 - 5])  # not a number goes right


def test_mean_shares_by_class_and_over_all(spark):
    rows = [(1, 0, [1.0, -3.0]), (1, 1, [0.0, 2.0]), (2, 0, [-1.0, 1.0]), (2, 1, [4.0, 0.0])]
    found = spark.createDataFrame(rows, "id int, cls int, phi array<double>")
    got = {(r.cls, r.feature): (r.importance, r["rank"]) for r in trees.mean_shares(found, ["a", "b"]).collect()}
    assert got == {(0, "a"): (1, 2), (0, "b"): (2, 1), (1, "a"): (2, 1), (1, "b"): (1, 2), (-1, "a"): (1.5, 1), (-1, "b"): (1.5, 2)}
    own = trees.mean_shares(found.withColumn("mine", F.col("id") - 1), ["a", "b"], "mine").where("cls >= 0")
    assert {(r.cls, r.feature): r.importance for r in own.collect()} == {(0, "a"): 1, (0, "b"): 3, (1, "a"): 4, (1, "b"): 0}


def test_categories_are_sets(table):
    forest = trees.ensemble(trees.node_table(RandomForestClassifier(labelCol="label", numTrees=6, maxDepth=4, seed=2).fit(table)))
    assert any(t.categories for t in forest)
