"""Conditioning of raw channels, and the whole chain on noisy channels of known rates."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsemill.operators import beats, conditioning, modalities


def test_parts_of_conditioning():
    x = np.array([1.0, 2, 2, 2, 3, 3, 1])
    assert conditioning.flat_samples(x, 3).tolist() == [False, True, True, True, False, False, False]
    y = np.append(np.tile([0.0, 1.0], 50), 40.0)
    assert conditioning.within(y, 6).tolist() == [*y[:-1], np.median(y)]
    z = np.random.default_rng(0).normal(size=40)
    padded = np.concatenate([[0, 0], z, [0, 0]])
    assert np.allclose(conditioning.running_median(z, 5), [np.median(padded[i : i + 5]) for i in range(40)]) and conditioning.running_median(z, 1) is z
    assert len(conditioning.conditioned(np.ones(500), 100, 100, 0.5, 8.0, 2)) == 0 and len(conditioning.conditioned(np.zeros(0), 100, 100, 0.5, 8.0, 2)) == 0
    t = np.arange(0, 20, 1 / 125)
    slow, fast = np.sin(2 * np.pi * 2 * t), np.sin(2 * np.pi * 30 * t)
    out = conditioning.conditioned(slow + fast + 5, 125, 250, 0.5, 8.0, 2)
    middle = slice(1000, 4000)
    assert len(out) == 5000 and np.abs(out - np.interp(np.arange(5000) / 250, t, slow))[middle].max() < 0.15


def bump(phase, at, width, height=1.0):
    return height * np.exp(-(((phase - at) / width) ** 2))


def test_whole_chain_on_noisy_channels(spark):
    rng, seconds, rates = np.random.default_rng(1), 60, {"II": 250.0, "Pleth": 125.0, "Resp": 62.5, "ABP": 125.0}
    rows = []
    for kind, fs in rates.items():
        t = np.arange(0, seconds, 1 / fs)
        beat = t * 75 / 60
        phase, late = beat % 1, (beat - 0.25) % 1
        x = {
            "II": bump(phase, 0.3, 0.03, 0.15) + bump(phase, 0.5, 0.015) - bump(phase, 0.55, 0.012, 0.2) + bump(phase, 0.8, 0.05, 0.3) + 0.3 * np.sin(2 * np.pi * 0.1 * t),
            "Pleth": bump(late, 0.35, 0.1) + bump(late, 0.7, 0.12, 0.4),
            "Resp": np.sin(2 * np.pi * t / 4),
            "ABP": 100 + 20 * np.cos(2 * np.pi * (late - 0.35)),
        }[kind]
        x = x + rng.normal(0, (0.0 if kind == "ABP" else 0.02) * np.ptp(x), len(x))
        x[500] += 50 * np.ptp(x)  # an outlier
        rows += [(1, kind.lower(), i, float(v)) for i, v in enumerate(x)]
    rows += [(2, "ii", i, 1.0) for i in range(600)] + [(3, "other", 0, 1.0)]
    samples = spark.createDataFrame(rows, "fin long, channel string, at int, value double")
    out = {r.fin: r for r in modalities.extract(samples, ["fin"], ["at"], rates, {k: k.lower() for k in rates}, target=125.0, statistics=("median", "valid_n")).collect()}
    assert set(out) == {1, 2, 3} and out[2].status == out[3].status == "no_signals"
    one = out[1]
    assert one.status == "perfect" and one.HR_bpm_median == pytest.approx(75, abs=1) and one.HR_ABP_median == pytest.approx(75, abs=2)
    assert one.resp_rate_Bpm_median == pytest.approx(15, abs=0.5) and one.SBP_median == pytest.approx(120, abs=1) and one.DBP_median == pytest.approx(80, abs=1)
    assert one.HRV_MeanNN == pytest.approx(800, abs=8) and one.HRV_TINN is not None and "edr_rate_Bpm_median" in one
    for name in ("HRV_TP", "HRV_SampEn", "HRV_MSE_0", "HRV_DFA_alpha1", "HRV_REC", "HRV_SDNN"):
        assert name in one
    assert 600 < one.T_rr_ms_valid_n * one.T_rr_ms_median / 75 < 800  # all but the beats at the ends


def test_segments_are_dealt_to_as_many_tasks_as_configured(spark):
    """Adaptive execution joined all of a small table's segments into one task, however long each takes; missing places come last."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (40, 50))
    rows = [(u, "ii", None if i == 49 else i, float(v)) for u in range(40) for i, v in enumerate(x[u])]
    samples = spark.createDataFrame(rows, "unit long, channel string, at int, value double").repartition(3)
    out = conditioning.condition(samples, ["unit"], ["at"], {"II": 50.0}, 50.0, {"II": "ii"}).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in out}) == 4
    found = {u: [r.value for r in sorted((r for r in out if r.unit == u), key=lambda r: r.i)] for u in range(40)}
    assert all(np.array_equal(found[u], conditioning.conditioned(x[u], 50.0, 50.0, *conditioning.FILTERS["II"])) for u in range(40))


def test_bins_of_a_wave_are_worked_out_once(spark):
    """They were made anew for each bin, with the wave's ends anew for each value: 7 times 30 times the square of its length."""
    x = np.random.default_rng(4).normal(0, 1, 6000)
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([1.0, 1.0],), ([],), (None,), (x.tolist(),)], "w array<double>")
    begin = time.monotonic()
    got = [r[0] for r in df.select(beats.entropy(F.col("w"), F.size("w"))).collect()]
    assert time.monotonic() - begin < 10
    p = np.histogram(x, 30)[0] / len(x)
    assert got[:4] == [pytest.approx(np.log2(3)), 0.0, None, None] and got[4] == pytest.approx(-(p[p > 0] * np.log2(p[p > 0])).sum(), abs=1e-3)
