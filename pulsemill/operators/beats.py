"""Pulse features with one row per pulse, as column expressions (inventory 2.12).

A pulse row holds the wave between two onsets and the places of its landmarks in
it (null if there is none).  Amplitudes are relative to the series' first onset,
times are in ms, areas are divided by the median pulse length and median
amplitude of the series.  A feature outside its bound, a multiple of the series'
median beat interval, is null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bound, over, reach_back, safe_div

WIDTHS = (10, 25, 33, 50, 66, 75)


def trapezoid(wave: Column) -> Column:
    """Area under an array over its least value, by trapezoids of width 1."""

    def area(x: Column) -> Column:
        inner = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) - (F.element_at(x, 1) + F.element_at(x, -1)) / 2
        return F.when(F.size(x) > 0, inner - F.array_min(x) * (F.size(x) - 1))

    return bound(wave, area)


def part(start: Column | int, stop: Column) -> Column:
    """The wave from one place up to, without, another."""
    begin = F.lit(start) if isinstance(start, int) else start
    return F.slice("wave", begin + 1, F.greatest(stop - begin, F.lit(0)))


def at(place: str | Column) -> Column:
    return F.get("wave", F.col(place) if isinstance(place, str) else place)


def slope(place: Column) -> Column:
    return (F.get("wave", place + 1) - F.get("wave", place - 1)) / 2


def nearest(wave: Column, level: Column) -> Column:
    """Place of the value nearest to a level."""
    gaps = bound(level, lambda at: F.transform(wave, lambda v: F.abs(v - at)))
    return bound(gaps, lambda g: F.array_position(g, F.array_min(g)) - 1)


def pulse_features(rows: DataFrame, key: str, fs: float) -> DataFrame:
    """Rows (key, cycle) with a column per feature."""
    w, whole, back = over([key], ["cycle"]), over([key]), reach_back([key], ["cycle"])
    ms = 1000.0 / fs
    n = F.size("wave") - 1
    peak = F.col("onset") + F.col("S")
    rows = rows.withColumn("Tsp_sp_ms", (peak - F.lag(peak).over(w)) * ms)
    rows = rows.withColumns({"ci": F.percentile("Tsp_sp_ms", 0.5).over(whole), "x0": F.first(at(F.lit(0))).over(back), "T": n * ms})
    ci, x0, length = F.col("ci"), F.col("x0"), F.col("T")
    t = {"os": F.col("S") * ms, "so": (n - F.col("S")) * ms, "sys": F.col("N") * ms, "dias": (n - F.col("N")) * ms, "ow": F.col("w") * ms, "wo": (n - F.col("w")) * ms}
    good = {"S": (t["os"] < 0.8 * ci) & (t["so"] < 0.8 * ci), "N": (t["sys"] < 0.8 * ci) & (t["dias"] < 0.8 * ci), "w": (t["ow"] < 0.5 * ci) & (t["wo"] < ci)}
    sd = (F.col("D") - F.col("S")) * ms
    up = at("S") - x0
    base = {
        "Ton_off_ms": F.when(length < ci + 150, length),
        "Tsp_sp_ms": F.when(F.col("Tsp_sp_ms") < ci + 150, F.col("Tsp_sp_ms")),
        "Delta_A_sp_sp": safe_div(at("S") - F.lag(at("S")).over(w), F.first(at("S")).over(back)),
        "max_upslope": slope(F.col("w")),
        "Delta_T_sd": F.when(sd < 0.6 * ci, sd),
        "RI": safe_div(at("D") - x0, up),
        "SI": safe_div(1000 * up, sd),
        "Delta_A_dn_dp": safe_div(at("D") - at("N"), x0),
        "T_dn_dp_ms": (F.col("D") - F.col("N")) * ms,
        "Augmentation_index": F.when(F.col("c") > F.col("S"), safe_div(at("c") - x0, up)),
        "A_dn": at("N") - x0,
        "DN_exists": F.col("N").isNotNull().cast("double"),
        "A_sp": up,
        "A_off": F.element_at("wave", -1) - x0,
        "A_AC": F.when(good["S"], at("S") - at(F.lit(0))),
    }
    for name, mark, first, second in (("S", "S", "os", "so"), ("N", "N", "sys", "dias"), ("w", "w", "ow", "wo")):
        base |= {f"T_{first}_ms": F.when(good[name], t[first]), f"T_{second}_ms": F.when(good[name], t[second])}
        base |= {f"_a_{first}": F.when(good[name], trapezoid(part(0, F.col(mark)))), f"_a_{second}": F.when(good[name], trapezoid(part(F.col(mark), n)))}
    base["_a_pulse"] = F.when(length < 1.75 * ci, trapezoid(part(0, n)))
    base |= {"mean_slope_os": F.when(good["S"], safe_div(at("S") - at(F.lit(0)), F.col("S"))), "mean_slope_so": F.when(good["S"], safe_div(F.element_at("wave", -1) - at("S"), n - F.col("S"))), "T_so_cd_ms": F.when(good["S"], t["so"] / length)}
    for x in WIDTHS:
        level = x0 + up * (x / 100)
        width = (F.col("S") - nearest(part(0, F.col("S")), level) + nearest(part(F.col("S"), n), level)) * ms
        base[f"PW_{x}"] = F.when(good["S"], width)
    # statistics of the wave over its least value
    lifted = bound(part(0, n), lambda x: bound(F.array_min(x), lambda low: F.transform(x, lambda v: v - low)))
    rows = rows.withColumns({"_w": F.when(length < ci + 180, lifted)} | base)
    total = lambda c, f: F.aggregate(c, F.lit(0.0), lambda a, v: a + f(v))
    size = F.size("_w")
    rows = rows.withColumn("mean_ppg", total(F.col("_w"), lambda v: v) / size)
    rows = _moments(rows, size)
    norm = lambda a, b: F.percentile(F.col(f"T_{a}_ms") + F.col(f"T_{b}_ms"), 0.5).over(whole) / ms * F.percentile("A_AC", 0.5).over(whole)
    areas = {"AUCos_nu": ("_a_os", norm("os", "so")), "AUCso_nu": ("_a_so", norm("os", "so")), "AUCow_nu": ("_a_ow", norm("ow", "wo")), "AUCwo_nu": ("_a_wo", norm("ow", "wo"))}
    # by definition of these two, twice the systolic time stands for the pulse
    areas |= {"AUC_sys_nu": ("_a_sys", norm("sys", "sys")), "AUC_dias_nu": ("_a_dias", norm("sys", "sys"))}
    areas["AUC_pulse_nu"] = ("_a_pulse", F.percentile(n.cast("double"), 0.5).over(whole) * F.percentile("A_AC", 0.5).over(whole))
    rows = rows.withColumns({k: safe_div(a, b) for k, (a, b) in areas.items()})
    rows = rows.withColumns({"PR": safe_div(F.lit(60_000.0), "Tsp_sp_ms"), "IPA": safe_div("AUC_dias_nu", "AUC_sys_nu")})
    return rows.select(key, "cycle", *feature_names())


def _moments(rows: DataFrame, size: Column) -> DataFrame:
    """Spread, shape and energy of the lifted wave ``_w``."""

    def moment(p: int) -> Column:
        return F.aggregate("_w", F.lit(0.0), lambda a, v: a + F.pow(v - F.col("mean_ppg"), F.lit(p))) / size

    rows = rows.withColumns({"variance_ppg": moment(2), "_m3": moment(3), "_m4": moment(4)})
    ordered = F.array_sort("_w")
    middle = (F.get(ordered, F.floor((size - 1) / 2).cast("int")) + F.get(ordered, F.floor(size / 2).cast("int"))) / 2
    return rows.withColumns(
        {
            "std_ppg": F.sqrt("variance_ppg"),
            "skewness_ppg": safe_div("_m3", F.pow("variance_ppg", F.lit(1.5))),
            "kurtosis_ppg": safe_div("_m4", F.pow("variance_ppg", F.lit(2))) - 3,
            "energy_ppg": F.aggregate("_w", F.lit(0.0), lambda a, v: a + v * v),
            "entropy_ppg": entropy(F.col("_w"), size),
            "median_ppg": middle,
        }
    )


def entropy(wave: Column, size: Column, bins: int = 30) -> Column:
    """Entropy in bits of the wave's histogram with equal bins; 0 for a flat one."""

    def bits(place: Column) -> Column:
        shares = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(place, lambda x: x == b)) / size)
        return F.aggregate(F.filter(shares, lambda p: p > 0), F.lit(0.0), lambda a, p: a - p * F.log2(p))

    def within(ends: Column) -> Column:
        low, high = ends["low"], ends["high"]
        place = F.transform(wave, lambda v: F.least(F.lit(bins - 1), F.floor((v - low) / F.nullif(high - low, F.lit(0.0)) * bins)))
        return F.when(high > low, bound(place, bits)).when(high == low, 0.0)

    return bound(F.struct(F.array_min(wave).alias("low"), F.array_max(wave).alias("high")), within)


def feature_names() -> list[str]:
    """All features, in the order of the table."""
    names = "Ton_off_ms Tsp_sp_ms PR Delta_A_sp_sp max_upslope Delta_T_sd RI SI Delta_A_dn_dp T_dn_dp_ms Augmentation_index mean_ppg median_ppg variance_ppg std_ppg skewness_ppg kurtosis_ppg entropy_ppg energy_ppg DN_exists"
    names += " AUC_pulse_nu AUC_sys_nu AUC_dias_nu IPA T_sys_ms T_dias_ms A_dn AUCow_nu AUCwo_nu T_ow_ms T_wo_ms AUCos_nu AUCso_nu T_os_ms T_so_ms T_so_cd_ms A_AC A_sp A_off mean_slope_os mean_slope_so"
    return [*names.split(), *[f"PW_{x}" for x in WIDTHS]]


def long_features(features: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """Rows (key, feature, cycle, value), ready for the per-series statistics."""
    return features.unpivot([key, "cycle"], list(names), "feature", "value")


def breaths(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, t: str) -> DataFrame:
    """Inspiration and expiration time of each breath (trough to peak, peak to next trough) and their ratio."""
    w = over(keys, order)
    v = F.col(value)
    turn = F.when((v > F.lag(v).over(w)) & (v >= F.lead(v).over(w)), "peak").when((v < F.lag(v).over(w)) & (v <= F.lead(v).over(w)), "trough")
    turns = df.withColumn("__k", turn).where("__k is not null")
    turns = turns.withColumns({"__from": F.lag(t).over(w), "__to": F.lead(t).over(w), "__before": F.lag("__k").over(w), "__after": F.lead("__k").over(w)})
    full = turns.where("__k = 'peak' and __before = 'trough' and __after = 'trough'")
    out = full.withColumns({"insp_time": F.col(t) - F.col("__from"), "exp_time": F.col("__to") - F.col(t)})
    return out.withColumn("insp_exp_ratio", safe_div("insp_time", "exp_time")).select(*keys, F.col(t).alias("peak_t"), "insp_time", "exp_time", "insp_exp_ratio")
