"""From the samples of a segment's channels to its feature row: ECG, pulse, breath, pressure and variability (inventory B16, B18, B19, H1-H5)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import dealt
from ..functions.registry import STATISTICS
from ..sources.staging import staged, staged_all
from . import beats, conditioning, fiducials, hrv, kernels, peaks, stats

KEY = ["key"]
ECG = "P_duration QRS_duration T_duration atrialSys_phase ventSys_phase pr_interval_ms pr_segment_ms st_interval_ms st_segment_ms qt_interval_ms qtc_interval_ms T_rr_ms HR_bpm".split()
ARRIVAL = ["pat_ms", "dpat_ms"]
CENTRE = ["center_freq_ppg_Hz"]
BREATH = ["resp_width_PPresp_s", "resp_rate_Bpm", "insp_time", "exp_time", "insp_exp_ratio"]
DERIVED = ["edr_rate_Bpm"]
PRESSURE = ["SBP", "DBP", "HR_ABP", "MAP", "PP_ABP", "CO", "TPR", "ShockIndex"]


def names() -> list[str]:
    """All features that are series of values in a segment."""
    return [*ECG, *ARRIVAL, *beats.feature_names(), *CENTRE, *BREATH, *PRESSURE]


def _long(df: DataFrame, place: str, columns: Sequence[str]) -> DataFrame:
    return df.select("key", F.col(place).cast("long").alias("i"), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(["key", "i"], list(columns), "feature", "value").where("value is not null")


def inner(found: DataFrame) -> DataFrame:
    """Without each key's first and last peak, which the filters' ends may have made."""
    w = fiducials.over(KEY)
    return found.withColumns({"__a": F.min("i").over(w), "__z": F.max("i").over(w)}).where("i > __a and i < __z").drop("__a", "__z")


def pressures(abp: DataFrame, fs: float, height: float = 50.0, whole: bool = False) -> DataFrame:
    """Rows (key, i) of each beat's pressures: systolic peaks at least 0.35 s apart, and the foot behind each."""
    if whole:
        systolic = staged(peaks.greedy_peaks(abp, KEY, 0.35 * fs, height, inner=True).select("key", "i", "v"), "peaks")
    else:
        systolic = fiducials.spaced_peaks(abp, KEY, max(1, round(0.35 * fs)), height)
    number = F.row_number().over(fiducials.over(KEY, ["i"])).alias("k")
    rate = 60.0 * fs / (F.col("i") - F.lag("i").over(fiducials.over(KEY, ["i"])))
    s = systolic.select("key", "i", F.col("v").alias("SBP"), rate.alias("HR_ABP"), number)
    d = fiducials.feet(abp, systolic, KEY).select("key", F.col("v").alias("DBP"), number)
    return hrv.haemodynamics(s.join(d, ["key", "k"]).drop("k"), "SBP", "DBP", "HR_ABP")


def beat_shapes(rows: DataFrame, peaks: DataFrame, fs: float, prefix: str) -> DataFrame:
    """One row per key: the three largest eigenvalues of its beats, each stretched to a second of 1 kHz, and the centre frequency of their first component.

    A beat reaches from 0.25 s before its peak to 0.25 s before the next one; the
    first and the last are left out.  A key is one bounded segment.
    """
    begin = peaks.select("key", (F.col("i") - max(1, round(0.25 * fs))).alias("i")).where("i >= 0")
    cut = fiducials.cycles(rows, begin, KEY).where("__whole")
    waves = cut.groupBy("key", "cycle").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("w")).select("key", "cycle", F.col("w.v").alias("w"))
    waves = waves.withColumn("__first", F.min("cycle").over(fiducials.over(KEY))).where("cycle > __first").drop("__first")
    held = waves.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("cycle", "w"))).alias("b")).select("key", F.col("b.w").alias("beats"))
    names = [f"{prefix}BeatCenterFreq", *(f"{prefix}Interbeat_eigval{k}" for k in (1, 2, 3))]

    def run(batches):
        for batch in batches:
            found = [kernels.beat_shape([np.asarray(w, float) for w in beats]) for beats in batch.column("beats").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array([f[k] for f in found], pa.float64()) for k in range(4))], ["key", *names])

    return held.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in names))


def features(samples: DataFrame, keys: Sequence[str], order: Sequence[str], fs: float, channels: Mapping[str, str], channel: str = "channel", value: str = "value", height: float = 50.0, whole: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Long features (key, feature, i, value), beat intervals (key, i, nn in ms) of the chosen source, and the pulse class and beat shapes of each key.

    ``channels`` names the channel of II, Pleth, Resp and ABP.  A channel that is
    absent or mostly flat gives no rows, and the others go on.  With ``whole`` the first
    and last peaks go, breaths and pressures have greedy peaks of a least width, and
    the breathing rate from the ECG is a feature.
    """
    rows = samples.withColumn("key", F.struct(*keys))
    of = lambda name: fiducials.usable(fiducials.indexed(rows.where(F.col(channel) == channels[name]), KEY, order, value), KEY, fs)
    # channels, peaks and landmarks are read by several features
    ecg, ppg, resp, abp = staged_all([of(name) for name in ("II", "Pleth", "Resp", "ABP")], "channel")
    trim = inner if whole else lambda found: found
    r, p = staged_all([trim(fiducials.r_peaks(ecg, KEY, fs)), trim(fiducials.pulse_peaks(ppg, KEY, fs))], "peaks")
    onsets = staged(fiducials.feet(ppg, p, KEY), "feet")
    marks = staged(fiducials.pulse_landmarks(ppg, onsets, KEY), "landmarks")
    waves = dealt(fiducials.pulse_rows(marks, ppg, KEY), *KEY)
    pulse = beats.pulse_features(waves, "key", fs)
    centre = kernels.per_series(waves, "key", "wave", {CENTRE[0]: lambda w: kernels.spectral_centroid(w - w.min(), fs)}, keep=["cycle"])
    rr, pp = staged_all([fiducials.intervals_ms(x, KEY, fs, "nn") for x in (r, p)], "intervals")
    cardiac = pp.groupBy("key").agg(F.percentile("nn", 0.5).alias("interval_ms"))
    if whole:
        belt = peaks.greedy_peaks(resp, KEY, 2 * fs, least_width=0.5 * fs, inner=True).select("key", "i", "v")
    else:
        belt = fiducials.spaced_peaks(resp, KEY, max(1, round(2 * fs)))
    widths = fiducials.breathing(belt, fiducials.derived_breaths(r, KEY, fs), fiducials.derived_breaths(p, KEY, fs), KEY, fs)
    cycles = beats.breaths(resp, KEY, ["i"], "v", "i").withColumns({c: F.col(c) / fs for c in ("insp_time", "exp_time")})
    parts = [
        _long(fiducials.ecg_intervals(fiducials.ecg_landmarks(ecg, r, KEY, fs), KEY, fs), "i", ECG),
        _long(fiducials.arrival_times(r, onsets, KEY, fs, cardiac), "i", ARRIVAL),
        _long(pulse, "cycle", beats.feature_names()),
        _long(centre, "cycle", CENTRE),
        _long(widths, "i", BREATH[:2]),
        _long(cycles, "peak_t", BREATH[2:]),
        _long(pressures(abp, fs, height, whole), "i", PRESSURE),
    ]
    if whole:
        derived = fiducials.derived_breaths(r, KEY, fs)
        rate = 60.0 * fs / (F.col("i") - F.lag("i").over(fiducials.over(KEY, ["i"])))
        parts.append(_long(derived.withColumn(DERIVED[0], rate), "i", DERIVED))
    # a union of stored tables: one of shuffled ones needs equal numbers of partitions, which adaptive execution changes
    parts = staged_all(parts, "features")
    source = hrv.choose_source(rr, pp, KEY).select("key", "source")
    nn = rr.withColumn("__s", F.lit("first")).unionByName(pp.withColumn("__s", F.lit("second")))
    nn = nn.join(source.withColumnRenamed("source", "__s"), ["key", "__s"]).drop("__s")
    single = fiducials.pulse_class(marks, ppg, KEY).join(beat_shapes(ecg, r, fs, "ecg"), "key", "full").join(beat_shapes(ppg, p, fs, "ppg"), "key", "full")
    return reduce(DataFrame.unionByName, parts), nn, single


def variability(nn: DataFrame) -> DataFrame:
    """One row per key with the indices of ``hrv`` that are aggregates, of intervals in ms (key, i, nn)."""
    d = nn.withColumn("d", F.col("nn") - F.lag("nn").over(fiducials.over(KEY, ["i"]))).withColumn("at", F.sum("nn").over(fiducials.reach_back(KEY, ["i"])))
    tables = [hrv.time_domain(d, KEY), hrv.windowed_contract(d, KEY, "at", 60_000.0), hrv.poincare(d, KEY), hrv.shape(d, KEY, ["i"]), hrv.contributions(hrv.asymmetry(d, KEY, ["i"])), hrv.fragmentation(d, KEY, ["i"])]
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, KEY, "left")
    return out.select("key", *[F.col(c).alias(f"HRV_{c}") for c in out.columns if c != "key"])


def whole_variability(nn: DataFrame) -> DataFrame:
    """``variability`` of cleaned intervals, with the base of the triangle, the frequency, non-linear and multiscale indices of each key's intervals.

    A key is one bounded segment, whose intervals are one array.
    """
    clean = staged(hrv.clean_intervals(nn, KEY, ["i"]).select("key", "i", F.col("clean").cast("double").alias("nn")).where("nn is not null"), "intervals")
    arrays = dealt(clean, *KEY).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("i", "nn"))).alias("x")).select("key", F.col("x.nn").alias("values"))
    every = {"TINN": kernels.triangle_base} | kernels.FREQUENCY | kernels.NONLINEAR | kernels.MULTISCALE
    found = kernels.per_series(arrays, "key", "values", every).drop("status").withColumnRenamed("CD", "CorrDim")  # names differ by more than case
    return variability(clean).join(found.select("key", *[F.col(c).alias(f"HRV_{c}") for c in found.columns if c != "key"]), "key", "full")


def extract(samples: DataFrame, keys: Sequence[str], order: Sequence[str], rates: Mapping[str, float], channels: Mapping[str, str], target: float = 1000.0, statistics: Sequence[str] = STATISTICS, height: float = 50.0) -> DataFrame:
    """One row per segment from raw channels of their own rates: conditioning, peaks and landmarks, each statistic of each feature, all variability indices of cleaned intervals, and a status."""
    clean = staged(conditioning.condition(samples, keys, order, rates, target, channels), "clean")
    every = samples.select(*keys).distinct()
    found = segment_rows(clean, keys, ["i"], target, channels, statistics, height=height, whole=True)
    return every.join(found, list(keys), "left").fillna("no_signals", ["status"])


def segment_rows(samples: DataFrame, keys: Sequence[str], order: Sequence[str], fs: float, channels: Mapping[str, str], statistics: Sequence[str] = STATISTICS, chosen: Sequence[str] | None = None, height: float = 50.0, whole: bool = False) -> DataFrame:
    """One row per segment: each statistic of each feature, the variability indices, the pulse class and a status."""
    long_, nn, single = features(samples, keys, order, fs, channels, height=height, whole=whole)
    chosen = list(chosen or names() + DERIVED * whole)
    summed = stats.series_stats(long_.where(F.col("feature").isin(chosen)), ["key", "feature"], ["i"], statistics=statistics)
    indices = (whole_variability if whole else variability)(nn)
    every = samples.select(F.struct(*keys).alias("key")).distinct()
    # a row for each key and feature, and a row for each key
    summed, indices, single, every = staged_all([summed, indices, single, every], "rows")
    wide = stats.wide_stats(summed, KEY, "feature", chosen, statistics)
    out = every.join(wide.withColumn("__some", F.lit(True)), "key", "left").join(indices, "key", "left").join(single, "key", "left")
    status = F.when(F.col("__some"), "perfect").otherwise("no_signals")
    return out.withColumn("status", status).select("key.*", *[c for c in out.columns if c not in ("key", "__some")], "status")
