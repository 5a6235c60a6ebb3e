"""Operators against values worked out by hand, and kernels against their properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsemill.functions import registry
from pulsemill.operators import beats, cleaning, hrv, kernels, modelling, outcomes, profiles, sequences, stats, windows


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_sixteen_statistics_of_one_to_four(spark):
    df = spark.createDataFrame([("a", i, float(i + 1)) for i in range(4)] + [("a", 9, None), ("b", 0, 5.0), ("c", 0, 2.0), ("c", 1, 2.0)], "k string, t int, value double")
    out = {r.k: r for r in stats.series_stats(df, ["k"], ["t"]).collect()}
    a = out["a"]
    wanted = dict(mean=2.5, median=2.5, std=1.118034, mad=1.0, iqr=1.5, min=1.0, max=4.0, p25=1.75, p75=3.25, skewness=0.0, kurtosis=-1.36, entropy=np.log(4), slope=1.0, autocorr_lag1=0.25, gini_index=0.25, valid_n=4)
    for k, v in wanted.items():
        assert a[k] == pytest.approx(v, abs=1e-5), k
    assert out["b"].slope is None and out["b"].valid_n == 1 and out["b"].entropy is None
    assert out["c"].skewness is None and out["c"].entropy == 0.0 and out["c"].autocorr_lag1 is None


def test_state_sequence_of_the_worked_example(spark):
    wide = spark.createDataFrame([(1, 3, 1, 1, 3, None, None), (2, 0, 0, 1, 1, 2, 2)], "fin int, label_seg0 int, label_seg1 int, label_seg2 int, label_seg3 int, label_seg4 int, label_seg5 int")
    long_ = sequences.block(sequences.from_wide(wide, ["fin"]), "segment", "30min")
    one = long_.where("fin = 1")
    assert rows(sequences.frequency(one, ["fin"], "state").select("state", "freq"), "state") == [(1, 0.5), (3, 0.5)]
    assert rows(sequences.transitions(one, ["fin"], "segment", "state", same=False).select("from_state", "to_state", "share"), "from_state") == [(1, 3, 0.5), (3, 1, 0.5)]
    assert rows(sequences.transitions(one, ["fin"], "segment", "state", same=True).select("from_state", "share"), "from_state") == [(1, 1.0)]
    assert rows(sequences.dwell(one, ["fin"], "segment", "state").select("state", "dwell"), "state") == [(1, 0.5), (3, 0.25)]
    # the whole first row of the worked example, with the states and changes that don't occur
    assert rows(sequences.frequency(one, ["fin"], "state", range(4)).select("state", "freq"), "state") == [(0, 0), (1, 0.5), (2, 0), (3, 0.5)]
    assert sequences.transitions(one, ["fin"], "segment", "state", False, range(4)).where("share = 0").count() == 10
    assert rows(sequences.transitions(one, ["fin"], "segment", "state", True, range(4)).select("from_state", "share"), "from_state") == [(0, 0), (1, 1.0), (2, 0), (3, 0)]
    assert rows(sequences.dwell(one, ["fin"], "segment", "state", range(4)).select("state", "dwell"), "state") == [(0, 0), (1, 0.5), (2, 0), (3, 0.25)]
    assert sequences.entropy(one, ["fin"], "state").first().entropy == pytest.approx(np.log(2))
    assert rows(sequences.first_lag(one, ["fin"], "segment", "state", [0, 1, 2, 3]).select("state", "first_lag"), "state") == [(0, 1.0), (1, 0.25), (2, 1.0), (3, 0.0)]


def test_missingness_report(spark):
    nulls = {"heart_rate": 2, "resp_rate": 7, "spo2": 1, "age": 1, "lactate": 3}
    df = spark.createDataFrame([tuple(None if i < n else 1.0 for n in nulls.values()) for i in range(7)], ", ".join(f"{c} double" for c in nulls))
    got = {r.feature: (r.missing_pct, r.risk) for r in cleaning.missingness_report(df, list(nulls)).collect()}
    assert got == {"resp_rate": (100.0, "High"), "lactate": (42.86, "Moderate"), "heart_rate": (28.57, "Low"), "spo2": (14.29, "Low"), "age": (14.29, "Low")}


def test_free_days(spark):
    grid = spark.createDataFrame([(1, 0, 1, 1), (1, 2, 1, 0), (2, 0, 1, 0), (2, 1, 1, 0)], "fin int, day int, vp_5 int, death_5 int")
    cohort = spark.createDataFrame([(1,), (2,), (3,)], "fin int")
    assert rows(outcomes.free_days(grid, cohort, "fin", ["vp"], "death", [5]), "fin") == [(1, 0), (2, 3), (3, 0)]
    assert rows(outcomes.free_days(grid, cohort, "fin", ["vp"], "death", [5], event_free_full=True), "fin") == [(1, 0), (2, 3), (3, 5)]


def test_intervals_join_and_gaps_stay(spark):
    df = spark.createDataFrame([(1, 0, 5, "a"), (1, 5, 9, "b"), (1, 11, 12, "c"), (1, 12, 13, "d")], "k int, s int, e int, u string")
    assert rows(windows.coalesce_intervals(df, ["k"], "s", "e", ["u"]), "s") == [(1, 0, 9, 2, "b"), (1, 11, 13, 2, "d")]


def test_fill_both_ways(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, 2.0), (1, 2, None), (2, 0, None)], "k int, t int, v double")
    assert rows(windows.fill_both_ways(df, ["k"], ["t"], ["v"]), "k", "t") == [(1, 0, 2.0), (1, 1, 2.0), (1, 2, 2.0), (2, 0, None)]


def test_greedy_correlation_filter(spark):
    rng = np.random.default_rng(0)
    a, d = rng.normal(size=200), rng.normal(size=200)
    df = spark.createDataFrame([(float(x), float(2 * x), float(x + 0.01 * y), float(y)) for x, y in zip(a, d, strict=True)], "a double, b double, c double, d double")
    assert [r.kept for r in cleaning.correlation_filter(df, ["a", "b", "c", "d"], 0.9).orderBy("position").collect()] == [True, False, False, True]
    assert cleaning.select_features(df, ["a", "b", "c", "d"])[1] == ["a", "d"]


def test_registry():
    assert len(registry.STATISTICS) == 16
    names = registry.with_statistics(["PR", "ppg_class"], ["PR"])
    assert len(names) == 17 and names[0] == "PR_mean" and names[-1] == "ppg_class"
    assert registry.kept_features(["PR_mean", "PR_max", "PR_valid_n", "MSE_1", "age"]) == ["PR_mean", "age"]
    assert registry.status_of(IndexError()) == "index_err" and registry.status_of(None) == "perfect"


def test_text_helpers(spark):
    df = spark.createDataFrame([("one two three four",)], "t string")
    assert df.select(profiles.wrap("t", 9)).first()[0] == "one two\nthree\nfour"
    text = spark.createDataFrame([("Name:\nabc def\nOther:\nx",), ("nothing",)], "t string")
    assert [r[0] for r in text.select(profiles.section("t", "Name")).collect()] == ["abc def", ""]
    assert [r[0] for r in spark.createDataFrame([('**Phenotype Name: "Hot Group"**',), ("x",)], "t string").select(profiles.phenotype_name("t")).collect()] == ["Hot Group", "Unnamed Phenotype"]


def test_filters_keep_what_they_should():
    t = np.arange(0, 20, 1 / 250)
    slow, wanted, fast = np.sin(2 * np.pi * 0.05 * t), np.sin(2 * np.pi * 2 * t), np.sin(2 * np.pi * 60 * t)
    y = kernels.band_pass(slow + wanted + fast, 250, 0.5, 8.0, 2)
    middle = slice(1000, -1000)
    assert np.abs(y[middle] - wanted[middle]).max() < 0.1
    assert kernels.spectral_centroid(wanted, 250) == pytest.approx(2, abs=0.5)
    r = kernels.resample(wanted, 250, 500)
    assert np.abs(r[2000:-2000] - np.sin(2 * np.pi * 2 * np.arange(len(r)) / 500)[2000:-2000]).max() < 0.01


def test_entropies_order_noise_and_sine():
    rng = np.random.default_rng(1)
    noise, sine = rng.normal(size=300), np.sin(np.arange(300) / 5)
    assert kernels.sample_entropy(noise) > kernels.sample_entropy(sine)
    assert kernels.fluctuation_exponent(np.cumsum(rng.normal(size=3000)), range(4, 12)) == pytest.approx(1.5, abs=0.2)
    assert kernels.higuchi(rng.normal(size=2000)) == pytest.approx(2, abs=0.1)
    assert kernels.lempel_ziv(noise) > kernels.lempel_ziv(sine)
    assert 0 <= kernels.recurrence(sine)["DET"] <= 1


def test_asymmetry_matches_numpy(spark):
    rng = np.random.default_rng(2)
    nn = rng.integers(600, 1000, 40).astype(float)
    df = hrv.nn_intervals(spark.createDataFrame([(1, i, float(t)) for i, t in enumerate(np.concatenate([[0], np.cumsum(nn)]))], "fin int, i int, t double"), ["fin"], ["i"], "t", 1.0)
    got = hrv.asymmetry(df, ["fin"], ["i"]).first()
    x, y = nn[:-1], nn[1:]
    d = (y - x) / np.sqrt(2)
    sd = np.sqrt((d[d > 0] ** 2).sum() / (len(x) - 1))
    assert pytest.approx(sd) == got.SD1d and got.C1d + got.C1a == pytest.approx(1) and got.C2d + got.C2a == pytest.approx(1)


def test_consensus_finds_planted_groups(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(3, 5)) * 10
    points = [(i, (centres[i % 3] + rng.normal(size=5)).tolist()) for i in range(120)]
    df = modelling.with_vector(spark.createDataFrame(points, "id int, v array<double>"), "v")
    labels = {r.id: r.cluster for r in modelling.consensus_labels(df, "id", k=3, resamples=3).collect()}
    assert len({(i % 3, c) for i, c in labels.items()}) == 3
    exact = modelling.silhouette(df.withColumn("c", F.col("id") % 3), "id", "c", "v").agg(F.avg("silhouette")).first()[0]
    linear = modelling.squared_silhouette(df.withColumn("c", F.col("id") % 3), "id", "c", "v").agg(F.avg("silhouette")).first()[0]
    assert exact > 0.7 and linear > exact


def test_silhouettes_are_euclidean_at_every_size(spark):
    rng = np.random.default_rng(5)
    n = 20_400
    label = np.arange(n) % 3
    label[7] = 9  # a cluster of one row
    v = rng.normal(size=(n, 2)) + label[:, None] * 2.0
    v[10] = v[13]
    df = spark.createDataFrame([(i, int(c), x.tolist()) for i, (c, x) in enumerate(zip(label, v, strict=True))], "id int, c int, v array<double>")
    got = {r.id: r.silhouette for r in modelling.silhouette(df, "id", "c", "v").collect()}
    assert len(got) == n and got[7] == 0
    for i in [10, 13, 100, 9001, 20_399]:
        far = np.sqrt(((v - v[i]) ** 2).sum(1))
        a = far[label == label[i]].sum() / ((label == label[i]).sum() - 1)
        b = min(far[label == c].mean() for c in {0, 1, 2, 9} - {label[i]})
        assert got[i] == pytest.approx((b - a) / max(a, b), abs=1e-9)


def test_long_and_short_series_by_segments(spark):
    rng = np.random.default_rng(9)
    whole = {1: rng.normal(size=3000).cumsum(), 2: rng.normal(size=300), 3: rng.normal(size=5), 4: np.array([np.nan])}
    rows = [(k, i, float(x)) for k, v in whole.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "fin int, t int, value double")
    cut = kernels.segments(df, "fin", ["t"], "value", margin=kernels.MARGIN)
    assert max(len(r["values"]) for r in cut.collect()) <= kernels.SEGMENT + 2 * kernels.MARGIN
    out = kernels.filtered(cut, "fin", "values", 10.0, 4.0, 0.2, keep=["segment"], core="core").orderBy("segment").collect()
    for k in (1, 2, 3):
        got = np.concatenate([r.filtered for r in out if r.fin == k])
        assert np.allclose(got, kernels.band_pass(whole[k], 10.0, 0.2, 4.0), atol=1e-6)
    centres = {r.fin: (r.center_freq, r.status) for r in kernels.welch_centroids(df, "fin", ["t"], "value", 1.0).collect()}
    for k in (1, 2, 3):
        assert centres[k][0] == pytest.approx(kernels.spectral_centroid(whole[k], 1.0))
    assert centres[4] == (None, "no_signals")
    bounded = kernels.per_series(kernels.segments(df, "fin", ["t"], "value"), "fin", "values", {"n": len, "SampEn": kernels.sample_entropy}, keep=["segment"]).collect()
    assert sorted((r.fin, r.segment, r.n) for r in bounded) == [(1, 0, 1024), (1, 1, 1024), (1, 2, 952), (2, 0, 300), (3, 0, 5), (4, 0, 0)]

    def too_large(x):
        raise MemoryError

    with pytest.raises(Exception, match="MemoryError"):
        kernels.per_series(cut, "fin", "values", {"x": too_large}).collect()


def test_nearest_rows_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    left = [(k, j, int(rng.integers(0, 30))) for k in range(6) for j in range(5)]
    right = [(int(rng.integers(0, 5)), i, int(rng.integers(0, 30)), None if rng.random() < 0.3 else float(i)) for i in range(40)] + [(5, 100, 3, None), (5, 99, 20, None)]
    wanted = {}
    for k, j, at in left:
        own = [r for r in right if r[0] == k]
        if own and all(r[3] is None for r in own):
            wanted[k, j] = min(own, key=lambda r: r[1])[1]
        elif own:
            wanted[k, j] = min(own, key=lambda r: (r[2] >= at, abs(r[2] - at), r[1]))[1]
    out = windows.nearest_signed(spark.createDataFrame(left, "k int, j int, at int"), spark.createDataFrame(right, "k int, id int, t int, v double"), "k", ["j"], "at", "t", ["id"], ["v"]).collect()
    assert {(r.k, r.j): r.id for r in out} == wanted and all(r.difference == r.t - dict(((k, j), a) for k, j, a in left)[r.k, r.j] for r in out)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k string, t int, value double")
    assert stats.series_stats(none, ["k"], ["t"]).count() == 0
    assert windows.first_per_key(none, ["k"], ["t"]).count() == 0


def test_exact_quantiles(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=20_000), rng.integers(0, 5, 20_000).astype(float)
    df = spark.createDataFrame([(float(x), float(y), None) for x, y in zip(a, b, strict=True)] + [(None, 2.0, None)], "a double, b double, c double")
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    out = {r.feature: r[1:] for r in stats.exact_quantiles(df, ["a", "b", "c"], probs).collect()}
    assert out["a"] == pytest.approx(tuple(np.quantile(a, probs))) and out["b"] == pytest.approx(tuple(np.quantile(np.append(b, 2.0), probs))) and "c" not in out
    few = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "a double")
    assert stats.exact_quantiles(few, ["a"], (0.25, 0.5)).first()[1:] == (1.5, 2.0)
