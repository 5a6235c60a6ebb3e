"""Models, estimators, timestamps and small filters on tables whose answers are known."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from pulsemill.operators import estimators, modelling, signals, windows


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 12, (4, 3))
    rows = [(i, i % 4, *map(float, centres[i % 4] + rng.normal(0, 0.5, 3))) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, label int, a double, b double, c double")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).cache()


def test_agreement_counts_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(modelling, "BLOCK_ROWS", 8)
    votes = np.random.default_rng(1).integers(0, 3, (50, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(votes)], "id long, votes array<int>")
    got = {r.agree: r.n for r in modelling.agreement_histogram(df, "id").collect()}
    wanted = np.zeros(5, int)
    for i in range(50):
        for j in range(i):
            wanted[(votes[i] == votes[j]).sum()] += 1
    assert [got.get(k, 0) for k in range(5)] == wanted.tolist()
    area = modelling.consensus_area(modelling.agreement_histogram(df, "id"), 4).first().area
    assert area == pytest.approx(np.cumsum(wanted)[:4].sum() / wanted.sum() / 4)


def test_number_of_clusters(blobs):
    curve, best = modelling.choose_k(blobs, "id", ks=(2, 3, 4, 5, 6, 7), resamples=4)
    areas = [r.area for r in curve.orderBy("k").collect()]
    assert best in (3, 4, 5) and areas[2] > areas[0]


def test_imputation_by_kind(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        x = float(rng.normal())
        rows.append((i, x, None if i % 10 == 0 else int(x > 0), None if i % 10 == 1 else int(np.clip(round(1.5 + x), 0, 3)), None if i % 10 == 2 else 2 * x + 1))
    df = spark.createDataFrame(rows, "id long, x double, flag int, grade int, y double")
    out = {r.id: r for r in modelling.chained_imputation(df, ["flag", "grade", "y", "x"], rounds=2, binary=["flag"], ordinal={"grade": (0, 3)}).collect()}
    assert dict(df.dtypes) == dict(modelling.chained_imputation(df, ["flag", "grade", "y", "x"], 1, ["flag"], {"grade": (0, 3)}).dtypes)
    flags = [out[i].flag == int(rows[i][1] > 0) for i in range(0, 400, 10)]
    assert np.mean(flags) > 0.9 and all(out[i].flag in (0, 1) and out[i].grade in (0, 1, 2, 3) for i in out)
    assert np.mean([abs(out[i].y - (2 * rows[i][1] + 1)) for i in range(2, 400, 10)]) < 0.5
    assert all(out[i].y == rows[i][4] for i in range(400) if i % 10 != 2)


@pytest.mark.parametrize("balance", ["weights", "oversample", "none"])
def test_cross_validation_and_bands(blobs, balance):
    df = blobs.withColumn("y", (F.col("label") == 0).cast("int"))
    scores = modelling.cross_validated(df, "id", "y", folds=3, trees=5, balance=balance).cache()
    assert scores.count() == 240 and scores.select("id").distinct().count() == 240
    bands = modelling.curve_bands(modelling.curve_points(scores, "y", "score", "fold"), "fold").orderBy("x").collect()
    assert len(bands) == 101 and bands[-1].tpr == 1 and bands[50].tpr > 0.95 and bands[50].precision > 0.95
    assert all(b.tpr_low <= b.tpr <= b.tpr_high for b in bands) and [b.tpr for b in bands] == sorted(b.tpr for b in bands)


def test_importance_by_class_and_stored_models(blobs, tmp_path):
    noisy = blobs.withColumn("noise", F.rand(1))
    x = VectorAssembler(inputCols=["a", "noise"], outputCol="x").transform(noisy)
    top = modelling.class_importance(x, "label", ["a", "noise"], "x", trees=5).where("rank = 1").collect()
    assert len(top) == 4 and {r.feature for r in top} == {"a"}
    model = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=3, seed=1).fit(blobs)
    modelling.save_model(model, str(tmp_path / "forest"))
    again = modelling.load_model(RandomForestClassificationModel, str(tmp_path / "forest"))
    assert again.transform(blobs).select("id", "prediction").collect() == model.transform(blobs).select("id", "prediction").collect()
    parts = modelling.by_block(blobs.withColumn("part", F.col("id") % 2), "part", lambda own: own.agg(F.count("*").alias("n")))
    assert {r.part: r.n for r in parts.collect()} == {0: 120, 1: 120}


def test_estimators(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0, 3.0), (2.0, 4.0, 5.0, 1.0), (3.0, 6.0, 5.0, 2.0)], "a double, b double, k double, c double")
    assert estimators.CorrelationFilter(["a", "b", "c"], 0.9).fit(df).transform(df).columns == ["a", "k", "c"]
    assert estimators.VarianceFilter(["a", "k"]).fit(df).transform(df).columns == ["a", "b", "c"]
    scaled = estimators.PopulationScaler(["a", "k"]).fit(df).transform(df).orderBy("b").collect()
    assert [r.k for r in scaled] == [0, 0, 0] and scaled[2].a == pytest.approx(1 / np.std([1, 2, 3]))
    assert [r.a for r in estimators.PopulationScaler(["a"], span=True).fit(df).transform(df).orderBy("b").collect()] == [0, 0.5, 1]


def test_timestamps(spark):
    df = spark.createDataFrame([(1, i) for i in range(5)], "k long, i int")
    out = windows.timestamps(df, 100.0, "ms", 7.0)
    assert [r.timestamp for r in out.orderBy("i").collect()] == [7, 17, 27, 37, 47] and windows.timestamp_faults(out, ["k"]).count() == 0
    assert windows.timestamp_faults(out.withColumn("timestamp", -F.col("timestamp")), ["k"]).count() == 4
    with pytest.raises(ValueError):
        windows.timestamps(df, 1.0, "hours")
    with pytest.raises(ValueError):
        windows.timestamps(df, 1.0, start=-1.0)


def test_deviation_and_blank_filters(spark):
    df = spark.createDataFrame([(1, i, 0.0 if i % 2 else 1.0) for i in range(30)] + [(1, 30, 50.0)], "k long, i int, v double")
    assert signals.within_deviations(df, ["k"], "v").count() == 30
    filled = signals.outliers_filled(df, ["k"], ["i"], "v").orderBy(F.desc("i")).first()
    assert filled.v == 0.0
    assert signals.not_blank(spark.createDataFrame([(" ",), ("x",), (None,), ("",)], "s string"), "s").count() == 1
