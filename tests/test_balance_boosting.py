"""Folds, synthetic rows and boosted trees against brute force."""

from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from pulsemill.operators import balance, boosting, modelling, trees


@pytest.mark.parametrize("part", [20_000, 40])
def test_folds_differ_by_one_at_most(spark, monkeypatch, part):
    monkeypatch.setattr(balance, "PART_ROWS", part)
    rows = [(i, None if i % 97 == 0 else "rare" if i % 50 == 3 else "abc"[i % 3]) for i in range(501)]
    df = spark.createDataFrame(rows, "id long, label string")
    out = balance.stratified_folds(df, "id", "label", 5).collect()
    assert len(out) == 501 and {(r.id, r.label) for r in out} == set(rows)
    for label in {r[1] for r in rows}:
        sizes = Counter(r.fold for r in out if r.label == label)
        assert max(sizes[f] for f in range(5)) - min(sizes[f] for f in range(5)) <= 1
    sizes = Counter(r.fold for r in out)
    assert set(sizes) == set(range(5)) and max(sizes.values()) - min(sizes.values()) <= 1
    again = {r.id: r.fold for r in balance.stratified_folds(df.repartition(3), "id", "label", 5).collect()}
    assert again == {r.id: r.fold for r in out}
    assert balance.stratified_folds(df.limit(0), "id", "label").count() == 0


def test_synthetic_rows_lie_between_near_rows_of_their_class(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (91, 3))
    cls = np.array([0] * 60 + [1] * 23 + [2] * 7 + [3])
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(cls, x, strict=True))] + [(500, None, [0.0] * 3)], "id long, label int, v array<double>")
    out = balance.with_synthetic(df, "id", "label", "v", k=4).collect()
    assert Counter(r.label for r in out) == {0: 60, 1: 60, 2: 60, 3: 60, None: 1}
    assert len({(r.id, r["copy"]) for r in out}) == len(out)
    shares = []
    for r in out:
        if r["copy"] == 0:
            assert r.id == 500 or np.allclose(r.v, x[r.id])
            continue
        same = np.flatnonzero((cls == r.label) & (np.arange(91) != r.id))
        near = same[np.argsort(((x[same] - x[r.id]) ** 2).sum(1))[:4]]
        if not len(near):
            assert np.allclose(r.v, x[r.id])
            continue
        fits = [((np.array(r.v) - x[r.id]) @ (x[j] - x[r.id]) / ((x[j] - x[r.id]) ** 2).sum(), j) for j in near]
        t = [t for t, j in fits if np.allclose(x[r.id] + t * (x[j] - x[r.id]), r.v) and -1e-9 <= t < 1]
        assert t
        shares.append(t[0])
    assert 0.4 < np.mean(shares) < 0.6
    many = Counter(r.id for r in out if r["copy"] and r.label == 1)
    assert max(many.values()) - min(many.values()) <= 1


def test_cross_validation_with_synthetic_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(i % 8 == 0), (rng.normal(0, 1, 2) + 3 * (i % 8 == 0)).tolist()) for i in range(160)]
    df = spark.createDataFrame(rows, "id long, y int, v array<double>").withColumn("features", array_to_vector("v"))
    scores = modelling.cross_validated(df, "id", "y", folds=4, trees=8, balance="synthetic").collect()
    assert sorted(r.id for r in scores) == list(range(160))
    per_fold = Counter((r.fold, r.y) for r in scores)
    assert {per_fold[f, 1] for f in range(4)} == {5} and {per_fold[f, 0] for f in range(4)} == {35}
    right = np.mean([(r.score > 0.5) == r.y for r in scores])
    assert right > 0.9


def table(spark, n=240, seed=2):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(0, 1, (n, 4)), 1)
    label = (x[:, 0] > 0).astype(int) + (x[:, 1] * x[:, 2] > 0.3)
    y = 2 * x[:, 0] - x[:, 1] ** 2 + 0.1 * rng.normal(0, 1, n)
    rows = [(i, int(label[i]), float(y[i]), x[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, label int, y double, v array<double>").repartition(3)
    return x, label, y, df.withColumns({"features": array_to_vector("v"), "two": (F.col("label") > 0).cast("int")}).cache()


@pytest.mark.parametrize("objective, target", [("softmax", "label"), ("logistic", "two"), ("squared", "y")])
def test_loss_falls_in_each_round(spark, objective, target):
    x, label, y, df = table(spark)
    forest, losses = boosting.boost(df, "id", target, objective=objective, rounds=5, depth=3)
    assert len(losses) == 6 and all(b < a for a, b in zip(losses[:-1], losses[1:], strict=True))
    assert len(forest) == 1 + 5 * (3 if objective == "softmax" else 1)
    out = {r.id: r for r in boosting.scored(forest, df, "id", objective=objective).collect()}
    if objective == "squared":
        assert losses[-1] == pytest.approx(np.mean([(out[i].prediction - y[i]) ** 2 / 2 for i in range(240)]))
    else:
        truth = label if objective == "softmax" else (label > 0).astype(int)
        assert losses[-1] == pytest.approx(-np.mean([np.log(out[i].scores[truth[i]]) for i in range(240)]))
        assert np.mean([out[i].prediction == truth[i] for i in range(240)]) > 0.85
    found = trees.contributions(forest, df.limit(20), "id").collect()
    score = sum(t.predict(x) for t in forest)
    assert all(r.base + sum(r.phi) == pytest.approx(score[r.id, r.cls], abs=1e-9) for r in found)


def test_first_tree_against_brute_force(spark):
    x, _, y, df = table(spark, 80)
    forest, _ = boosting.boost(df, "id", "y", objective="squared", rounds=1, depth=2, rate=1.0, bins=256, least=3)

    def grown(rows, depth):
        gap = y.mean() - y[rows]
        best = (1e-9, None)
        if depth:
            for f in range(4):
                for t in np.unique(x[rows, f])[:-1]:
                    left = x[rows, f] <= t
                    if min(left.sum(), (~left).sum()) >= 3:
                        gain = gap[left].sum() ** 2 / (left.sum() + 1) + gap[~left].sum() ** 2 / ((~left).sum() + 1) - gap.sum() ** 2 / (len(rows) + 1)
                        if gain > best[0] + 1e-12:
                            best = (gain, (f, t))
        if best[1] is None:
            return {int(i): -gap.sum() / (len(rows) + 1) for i in rows}
        f, t = best[1]
        return grown(rows[x[rows, f] <= t], depth - 1) | grown(rows[x[rows, f] > t], depth - 1)

    wanted = grown(np.arange(80), 2)
    got = forest[1].predict(x)[:, 0]
    assert np.allclose(got, [wanted[i] for i in range(80)])


def test_missing_values_go_right(spark):
    rows = [(i, 5.0 if i % 4 == 0 else 0.0, [float("nan") if i % 4 == 0 else float(i % 3)]) for i in range(80)] + [(99, None, [1.0])]
    df = spark.createDataFrame(rows, "id long, y double, v array<double>").withColumn("features", array_to_vector("v"))
    forest, losses = boosting.boost(df, "id", "y", objective="squared", rounds=3, depth=1, rate=1.0, penalty=0.0)
    assert losses[-1] < 1e-12
    assert {r.id: round(r.prediction, 6) for r in boosting.scored(forest, df.limit(8), "id", objective="squared").collect()} == {i: 5.0 if i % 4 == 0 else 0.0 for i in range(8)}


def test_rows_of_equal_bins_are_one_row_of_the_state(spark, monkeypatch):
    sizes = []
    plain = boosting.staged

    def counted(df, name):
        out = plain(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(boosting, "staged", counted)
    df = spark.range(300).select("id", F.col("id").cast("double").alias("y"), array_to_vector(F.array((F.col("id") % 3).cast("double"))).alias("features"))
    _, losses = boosting.boost(df, "id", "y", objective="squared", rounds=2, depth=2, rate=1.0, penalty=0.0)
    assert sizes == [3, 3, 3]
    y = np.arange(300.0)
    means = np.array([y[i % 3 :: 3].mean() for i in range(300)])
    assert losses == pytest.approx([((y - y.mean()) ** 2).mean() / 2, *[((y - means) ** 2).mean() / 2] * 2])
