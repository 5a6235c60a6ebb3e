"""Imputation from sums of products against regressions on the rows themselves."""

import numpy as np
import pytest

from pulsemill.operators import imputation


def ridge_on_rows(x, y):
    """Evidence maximisation on the rows, by solving for the weights anew in each step."""
    xc, yc = x - x.mean(0), y - y.mean()
    n, p = x.shape
    alpha, lam, old = 1 / (y.var() + np.finfo(float).eps), 1.0, None
    for _ in range(300):
        coef = np.linalg.solve(xc.T @ xc + lam / alpha * np.eye(p), xc.T @ yc)
        if old is not None and np.abs(old - coef).sum() < 1e-3:
            break
        old = coef
        sigma = np.linalg.inv(lam * np.eye(p) + alpha * xc.T @ xc)
        gamma = p - lam * np.trace(sigma)
        lam = (gamma + 2e-6) / ((coef**2).sum() + 2e-6)
        alpha = (n - gamma + 2e-6) / (((yc - xc @ coef) ** 2).sum() + 2e-6)
    return y.mean() - x.mean(0) @ coef, coef


def test_one_column_with_gaps_equals_a_ridge_on_the_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (300, 3)) * [1, 5, 0.1] + [0, 100, 3]
    y = x @ [2, 0.3, -4] + rng.normal(0, 0.5, 300)
    gone = np.arange(300) % 7 == 0
    rows = [(i, f"k{i}", *map(float, x[i]), None if gone[i] else float(y[i])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, key string, a double, b double, c double, y double").repartition(4)
    out, moves = imputation.regression_imputation(df, ["a", "b", "c", "y"])
    assert out.columns == df.columns and len(moves) == 2 and moves[-1] < 1e-9
    base, coef = ridge_on_rows(x[~gone], y[~gone])
    got = {r.id: r for r in out.collect()}
    assert len(got) == 300 and all(got[i].key == f"k{i}" for i in range(300))
    assert all(got[i].y == pytest.approx(base + x[i] @ coef, abs=1e-8) if gone[i] else got[i].y == y[i] for i in range(300))


def test_rounds_converge_to_a_fixed_point(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(0, 1, (400, 2))
    x = np.column_stack([z[:, 0], z[:, 0] + 0.2 * rng.normal(0, 1, 400), z[:, 1], z.sum(1) + 0.2 * rng.normal(0, 1, 400)])
    missing = rng.random(x.shape) < 0.15
    rows = [(i, *[None if m else float(v) for v, m in zip(x[i], missing[i], strict=True)]) for i in range(400)]
    out, moves = imputation.regression_imputation(spark.createDataFrame(rows, "id long, a double, b double, c double, d double"), ["a", "b", "c", "d"], rounds=25, tolerance=1e-6)
    assert moves[-1] < 1e-5 and len(moves) < 25
    got = np.array([[r.a, r.b, r.c, r.d] for r in out.orderBy("id").collect()])
    assert np.allclose(got[~missing], x[~missing])
    for c in range(4):
        others = [j for j in range(4) if j != c]
        base, coef = ridge_on_rows(got[~missing[:, c]][:, others], got[~missing[:, c], c])
        assert np.allclose(got[missing[:, c], c], base + got[missing[:, c]][:, others] @ coef, atol=1e-4)
    assert np.corrcoef(got[missing[:, 1], 1], x[missing[:, 1], 1])[0, 1] > 0.8


def test_kinds_of_columns_and_odd_tables(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(0, 1, 400)
    rows = [(i, float(v[i]), None if i % 9 == 0 else int(v[i] + 0.3 * rng.normal() > 0), None if i % 9 == 1 else int(np.clip(round(1.5 + v[i]), 0, 3)), None, 5.0 if i % 9 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, x double, flag int, grade int, never double, same double")
    names = ["x", "flag", "grade", "never", "same"]
    out, moves = imputation.regression_imputation(df, names, rounds=8, binary=["flag"], ordinal={"grade": (0, 3)})
    got = {r.id: r for r in out.collect()}
    assert dict(out.dtypes) == dict(df.dtypes) and len(got) == 400
    assert all(r.flag in (0, 1) and r.grade in (0, 1, 2, 3) and r.never is None and r.same == pytest.approx(5) for r in got.values())
    assert np.mean([got[i].flag == (v[i] > 0) for i in range(0, 400, 9)]) > 0.85
    assert np.mean([abs(got[i].grade - np.clip(round(1.5 + v[i]), 0, 3)) for i in range(1, 400, 9)]) < 0.3
    empty, moves = imputation.regression_imputation(df.limit(0), names)
    assert empty.count() == 0 and imputation.regression_imputation(df.select("id", "x"), ["x"])[0].count() == 400
