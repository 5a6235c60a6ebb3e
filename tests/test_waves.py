"""The chain from waves to features on simulated channels whose rates and delays are known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsemill.operators import beats, fiducials, hrv, kernels, modalities, windows
from pulsemill.operators.modelling import roc_points

FS, SECONDS, RATE = 100, 40, 75  # 800 ms a beat


def bump(phase, at, width, height=1.0):
    return height * np.exp(-(((phase - at) / width) ** 2))


@pytest.fixture(scope="module")
def waves(spark):
    t = np.arange(0, SECONDS, 1 / FS)
    beat = t * RATE / 60
    phase = beat - np.floor(beat)
    late = (beat - 0.25) - np.floor(beat - 0.25)  # the pulse comes a quarter of a beat later
    channels = {
        "II": bump(phase, 0.3, 0.03, 0.15) + bump(phase, 0.45, 0.012, -0.12) + bump(phase, 0.5, 0.015) + bump(phase, 0.55, 0.012, -0.2) + bump(phase, 0.8, 0.05, 0.3),
        "Pleth": bump(late, 0.35, 0.1) + bump(late, 0.7, 0.12, 0.4),
        "Resp": np.sin(2 * np.pi * t / 4),  # 15 breaths a minute
        "ABP": 80 + 40 * bump(late, 0.35, 0.12),
    }
    rows = [(1, 0, c, i, float(v)) for c, x in channels.items() for i, v in enumerate(x)]
    rows += [(2, 0, "II", i, 1.0) for i in range(500)]  # a flat line
    return spark.createDataFrame(rows, "fin long, segment long, channel string, i int, value double").cache()


NAMES = {c: c for c in ("II", "Pleth", "Resp", "ABP")}


def of(waves, channel):
    return waves.where((F.col("channel") == channel) & (F.col("fin") == 1)).select("fin", "i", F.col("value").alias("v"))


def test_peaks_and_intervals(waves):
    r = [x.i for x in fiducials.r_peaks(of(waves, "II"), ["fin"], FS).orderBy("i").collect()]
    assert len(r) in (49, 50) and set(np.diff(r)) == {80}
    p = [x.i for x in fiducials.pulse_peaks(of(waves, "Pleth"), ["fin"], FS).orderBy("i").collect()]
    assert len(p) >= 48 and set(np.diff(p)) <= {79, 80, 81}


def test_segment_row(waves):
    out = {r.fin: r for r in modalities.segment_rows(waves, ["fin", "segment"], ["i"], FS, NAMES, statistics=("median", "valid_n")).collect()}
    one, two = out[1], out[2]
    assert one.status == "perfect" and two.status == "no_signals" and two.HR_bpm_median is None
    assert one.HR_bpm_median == pytest.approx(75) and one.PR_median == pytest.approx(75, abs=1) and one.T_rr_ms_median == pytest.approx(800)
    # P at 0.3, R at 0.5 and T at 0.8 of a beat
    assert one.atrialSys_phase_median == pytest.approx(160, abs=15) and 200 < one.ventSys_phase_median < 450 and one.qt_interval_ms_median > one.st_interval_ms_median
    # the pulse begins before its peak, which comes 0.1 of a beat behind R
    assert one.Ton_off_ms_median == pytest.approx(800, abs=10) and 0 < one.pat_ms_median < 800 and abs(one.dpat_ms_median) < 11
    assert one.resp_rate_Bpm_median == pytest.approx(15, abs=0.5) and one.insp_time_median == pytest.approx(2, abs=0.1)
    assert one.SBP_median == pytest.approx(120, abs=1) and 80 <= one.DBP_median < 90 and one.HR_ABP_median == pytest.approx(75, abs=1)
    # equal beats have one component
    assert one.ecgInterbeat_eigval1 > 100 * one.ecgInterbeat_eigval2 and one.ppgInterbeat_eigval1 > 100 * one.ppgInterbeat_eigval2 and one.ecgBeatCenterFreq > one.ppgBeatCenterFreq > 0
    assert 0 < one.entropy_ppg_median < 5 and one.DN_exists_median in (0, 1) and one.center_freq_ppg_Hz_median > 0
    assert one.HRV_MeanNN == pytest.approx(800) and one.HRV_SDNN == pytest.approx(0, abs=1e-6) and one.ppg_class in ("Class1", "Class2", "Class3", "Unknown")


def test_pulse_features_of_a_clean_wave(waves):
    x = of(waves, "Pleth")
    marks = fiducials.pulse_landmarks(x, fiducials.feet(x, fiducials.pulse_peaks(x, ["fin"], FS), ["fin"]), ["fin"])
    rows = beats.pulse_features(fiducials.pulse_rows(marks, x, ["fin"]), "fin", FS).collect()
    middle = rows[len(rows) // 2]
    assert middle.T_os_ms + middle.T_so_ms == pytest.approx(middle.Ton_off_ms) and middle.PW_10 > middle.PW_50 > middle.PW_75 > 0
    assert 0 < middle.RI < 1 and middle.mean_slope_os > 0 > middle.mean_slope_so and middle.IPA > 0
    assert middle.std_ppg**2 == pytest.approx(middle.variance_ppg)


def test_breaths_from_the_heart_rate(spark):
    """Beats that come faster and slower once in ten."""
    at = np.cumsum(1 + 0.1 * np.sin(2 * np.pi * np.arange(100) / 10)) * FS
    peaks = spark.createDataFrame([(1, int(i)) for i in at], "fin long, i int")
    found = [r.i for r in fiducials.derived_breaths(peaks, ["fin"], FS).orderBy("i").collect()]
    assert len(found) in (9, 10) and np.diff(found) / FS == pytest.approx(10, abs=1.2)
    none = spark.createDataFrame([], "fin long, i int")
    out = fiducials.breathing(none, peaks.where("false"), spark.createDataFrame([(1, i) for i in found], "fin long, i int"), ["fin"], FS).collect()
    assert {r.source for r in out} == {"PDR"} and len(out) == len(found) - 1


def test_variability_of_known_intervals(spark):
    nn = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate([800, 810, 790, 800, 820, 800, 790])], "key long, i int, nn double")
    out = modalities.variability(nn).first()
    up, down = [10, 10, 20], [20, 20, 10]
    assert out.HRV_GI == pytest.approx(100 * sum(up) / (sum(up) + sum(down))) and out.HRV_PI == pytest.approx(50)
    assert out.HRV_Cd + out.HRV_Ca == pytest.approx(1) and out.HRV_SDANN1 is None
    assert hrv.windowed_contract(nn.withColumn("at", F.col("i") * 30_000.0), ["key"], "at", 60_000.0).first().SDNNI1 == pytest.approx(np.mean([np.std(x, ddof=1) for x in ([800, 810], [790, 800], [820, 800])]))


def test_filter_sections_against_the_recurrence():
    rng = np.random.default_rng(6)
    for order, cutoff, kind in ((2, 0.5, "high"), (4, 8.0, "low"), (3, 15.0, "low")):
        for n in (5, 64, 1000):
            x = rng.normal(size=n).cumsum()
            for b, a in kernels.butterworth(order, cutoff, 250, kind):
                gain = b.sum() / a.sum()
                z2 = (b[2] - a[2] * gain) * x[0]
                z1 = (b[1] - a[1] * gain) * x[0] + z2
                wanted = []
                for v in x:
                    y = b[0] * v + z1
                    z1, z2 = b[1] * v - a[1] * y + z2, b[2] * v - a[2] * y
                    wanted.append(y)
                assert np.allclose(kernels.run_section(b, a, x), wanted, rtol=1e-8, atol=1e-8)


def test_multifractal_and_multiscale():
    rng = np.random.default_rng(3)
    white = rng.normal(size=900)
    out = kernels.multiscale(white, 5)
    assert out["MSE_0"] == pytest.approx(kernels.sample_entropy(white)) and out["MSE_0"] > out["MSE_4"] and out["CMSEn"] > 0 and out["RCMSEn"] > 0
    spectrum = kernels.multifractal(white, range(12, 90))
    assert spectrum["Peak"] == pytest.approx(0.5, abs=0.2) and spectrum["Width"] > 0 and 0 <= spectrum["Asymmetry"] <= 1


def test_long_series_take_linear_time(spark):
    """One series of 400,000 rows; a frame that is made anew for each row would take hours."""
    df = spark.range(400_000).select(F.lit(1).alias("k"), F.col("id").alias("t"), F.when(F.col("id") % 7 == 0, F.col("id").cast("double")).alias("v"))
    out = windows.fill_both_ways(df, ["k"], ["t"], ["v"]).agg(F.sum("v"), F.count("v")).first()
    assert out[1] == 400_000 and out[0] == sum(7.0 * (i // 7) for i in range(400_000))
    out = windows.next_within(df, ["k"], ["t"], "t", F.col("t") % 5 == 0, F.col("v").isNotNull())
    assert out.where("delay between 1 and 7").count() >= 79_999
    frames = [windows.fill_both_ways(df, ["k"], ["t"], ["v"]), hrv.clean_intervals(df.withColumnRenamed("v", "nn"), ["k"], ["t"]), roc_points(df.withColumn("y", F.col("t") % 2), "y", "v")]
    assert not any("2147483647" in d._jdf.queryExecution().toString() for d in frames)
