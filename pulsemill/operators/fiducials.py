"""Landmarks of waves as rows: peaks, slope reversals, zero crossings, pulse and ECG waves (inventory 2.11, 2.12).

A wave is a long table with one row per sample: its keys (encounter, segment),
its place ``i`` from 0 on and its value ``v``.  All searches are windows over the
keys and conditional aggregates, so a landmark is a place or null; a key is one
bounded segment, as ``windows.backward_segments`` cuts them.  Times are places
over the sampling rate ``fs``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import over, reach_back, safe_div, whole


def indexed(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "value") -> DataFrame:
    """Rows (keys, i, v) of the finite values, in order."""
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return rows.select(*keys, (F.row_number().over(over(keys, order)) - 1).alias("i"), v.alias("v"))


def moving_mean(rows: DataFrame, keys: Sequence[str], column: str, width: int, out: str) -> DataFrame:
    """Mean of the ``width`` // 2 neighbours on either side and the row itself, as far as they exist.

    Each frame is summed by itself: differences of running sums carry the rounding of all rows before, which settles ties.
    """
    half = width // 2
    return rows.withColumn(out, F.avg(column).over(over(keys, ["i"]).rowsBetween(-half, half)))


def energy_peaks(rows: DataFrame, keys: Sequence[str], energy: Column, short: int, long: int, factor: float = 1.0, offset: float = 0.0, least: float = 0.0, share: float = 0.0, apart: int = 0) -> DataFrame:
    """Rows (keys, i, v): the highest sample of each stretch where the short moving mean of the energy exceeds the long one.

    The long mean counts ``factor`` times, and ``offset`` times the key's mean energy is
    added.  Stretches below ``least`` samples, or below ``share`` of their mean
    length, are left out, and peaks at most ``apart`` samples behind another.
    """
    e = rows.withColumn("__e", energy)
    e = moving_mean(moving_mean(e, keys, "__e", short, "__short"), keys, "__e", long, "__long")
    e = e.withColumn("__in", F.col("__short") > factor * F.col("__long") + offset * F.avg("__e").over(whole(keys, ["i"])))
    e = e.withColumn("__new", F.coalesce((F.col("__in") != F.lag("__in").over(over(keys, ["i"]))).cast("int"), F.lit(1)))
    e = e.withColumn("__island", F.sum("__new").over(reach_back(keys, ["i"])))
    stretch = e.where("__in").groupBy(*keys, "__island").agg(F.count("*").alias("__n"), F.max_by(F.struct("i", "v"), F.struct("v", -F.col("i"))).alias("__p"))
    stretch = stretch.withColumn("__mean", F.avg("__n").over(over(keys))).where((F.col("__n") >= least) & (F.col("__n") >= share * F.col("__mean")))
    peaks = stretch.select(*keys, "__p.*")
    gap = F.col("i") - F.lag("i").over(over(keys, ["i"]))
    return peaks.withColumn("__gap", gap).where(F.col("__gap").isNull() | (F.col("__gap") > apart)).drop("__gap")


def r_peaks(rows: DataFrame, keys: Sequence[str], fs: float) -> DataFrame:
    """R peaks: stretches of steep slope of at least 0.4 of their mean length, 0.3 s apart."""
    w = over(keys, ["i"])
    slope = F.abs((F.coalesce(F.lead("v").over(w), F.col("v")) - F.coalesce(F.lag("v").over(w), F.col("v"))) / 2)
    return energy_peaks(rows, keys, slope, max(1, round(0.1 * fs)), max(1, round(0.75 * fs)), factor=1.5, share=0.4, apart=round(0.3 * fs))


def pulse_peaks(rows: DataFrame, keys: Sequence[str], fs: float) -> DataFrame:
    """Systolic peaks: stretches where the squared signal over its median is high, 0.3 s apart."""
    high = F.greatest(F.col("v") - F.percentile("v", 0.5).over(over(keys)), F.lit(0.0))
    short = max(1, round(0.111 * fs))
    return energy_peaks(rows, keys, high * high, short, max(1, round(0.667 * fs)), offset=0.02, least=short, apart=round(0.3 * fs))


def spaced_peaks(rows: DataFrame, keys: Sequence[str], distance: int, height: float | None = None) -> DataFrame:
    """Local maxima of at least ``height`` with no higher one (of equals no earlier one) at a place nearer than ``distance``."""
    w = over(keys, ["i"])
    v = F.col("v")
    peak = (v > F.lag("v").over(w)) & (v >= F.lead("v").over(w))
    maxima = rows.withColumn("__p", peak if height is None else peak & (v >= height)).where("__p").select(*keys, "i", "v")
    best = F.max(F.struct("v", -F.col("i"))).over(w.rangeBetween(-distance + 1, distance - 1)) if distance > 1 else F.struct("v", -F.col("i"))
    return maxima.withColumn("__b", best).where(F.col("__b") == F.struct("v", -F.col("i"))).drop("__b")


def _ruled(found: DataFrame, keys: Sequence[str], rule: str, backwards: bool) -> DataFrame:
    """One of the places found in each key, or all."""
    if rule == "all":
        return found
    ends = {"first": -F.col("i") if backwards else F.col("i"), "last": F.col("i") if backwards else -F.col("i"), "max": F.struct(-F.col("v"), F.col("i")), "min": F.struct(F.col("v"), F.col("i"))}
    return found.groupBy(*keys).agg(F.min_by(F.struct("i", "v"), ends[rule]).alias("__x")).select(*keys, "__x.*")


def turn(kind: str, backwards: bool, before: Column, after: Column) -> Column:
    """Whether the slope changes its sign, by the differences to the samples before and after."""
    return {
        ("positive", False): (before < 0) & (after >= 0), ("positive", True): (before >= 0) & (after < 0),
        ("negative", False): (before > 0) & (after <= 0), ("negative", True): (before <= 0) & (after > 0),
    }.get((kind, backwards), F.signum(before) != F.signum(after))


def crossing(kind: str, v: Column, after: Column) -> Column:
    """Whether the next sample is across zero."""
    return {"positive": (v < 0) & (after >= 0), "negative": (v > 0) & (after <= 0)}.get(kind, (v == 0) & (after != 0))


def slope_reversals(rows: DataFrame, keys: Sequence[str], kind: str = "both", backwards: bool = False, rule: str = "all") -> DataFrame:
    """Places where the slope changes its sign: ``positive`` from falling to not falling, ``negative`` from rising to not rising.

    Seen ``backwards`` a flat stretch counts at its other end.  ``rule``: all, first,
    max or min of each key.
    """
    w = over(keys, ["i"])
    before, after = F.col("v") - F.lag("v").over(w), F.lead("v").over(w) - F.col("v")
    return _ruled(rows.withColumn("__t", turn(kind, backwards, before, after)).where("__t").select(*keys, "i", "v"), keys, rule, backwards)


def zero_crossings(rows: DataFrame, keys: Sequence[str], kind: str = "both", backwards: bool = False, rule: str = "all") -> DataFrame:
    """Places before a crossing of zero: ``positive`` upwards, ``negative`` downwards, ``both`` where a zero ends.

    ``rule``: all, first or last of each key in the direction of the scan; ``last``
    gives the place behind the end, with the last value, where there is none.
    """
    v, after = F.col("v"), F.lead("v").over(over(keys, ["i"]))
    marked = rows.withColumn("__t", F.coalesce(crossing(kind, v, after), F.lit(False)))
    if rule != "last":
        return _ruled(marked.where("__t").select(*keys, "i", "v"), keys, rule, backwards)
    side = F.col("i") if not backwards else -F.col("i")
    out = marked.groupBy(*keys).agg(F.max_by(F.when(F.col("__t"), F.struct("i", "v")), F.when(F.col("__t"), side)).alias("__x"), (F.max("i") + 1).alias("__n"), F.max_by("v", "i").alias("__v"))
    return out.select(*keys, F.coalesce("__x.i", "__n").alias("i"), F.coalesce("__x.v", "__v").alias("v"))


def every_rule(rows: DataFrame, keys: Sequence[str], found: dict[tuple, Column], rules: dict[str, Sequence[str]], names: Sequence[str]) -> DataFrame:
    """Rows (keys, names, rule, i, v) of all kinds of places and all rules in one pass over the rows.

    ``found`` has a condition for each kind, a tuple of values for ``names``; ``rules`` the rules of each kind besides ``all``.
    One branch for each kind and rule would hold as many sorts in each task.
    """
    whole_key, here = over(keys), F.struct("i", "v")
    marked = rows.withColumns({f"__{n}": F.coalesce(c, F.lit(False)) for n, c in enumerate(found.values())})
    by = {"first": F.col("i"), "last": -F.col("i"), "max": F.struct(-F.col("v"), F.col("i")), "min": F.struct(F.col("v"), F.col("i"))}
    picks, hits = {}, []
    for n, kind in enumerate(found):
        own = [F.lit("all")]
        for rule in rules[kind]:
            picks[f"__{n}_{rule}"] = F.min(F.when(F.col(f"__{n}"), by[rule])).over(whole_key)
            own.append(F.when(F.col(f"__{n}_{rule}") == by[rule], F.lit(rule)))
        labels = [F.lit(x).alias(name) for x, name in zip(kind, names, strict=True)]
        hits.append(F.when(F.col(f"__{n}"), F.struct(*labels, F.filter(F.array(*own), lambda r: r.isNotNull()).alias("rules"))))
    out = marked.withColumns(picks).select(*keys, here.alias("__at"), F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("__h"))
    return out.select(*keys, *[f"__h.{n}" for n in names], F.explode("__h.rules").alias("rule"), "__at.*")


def ruled_reversals(rows: DataFrame, keys: Sequence[str], rules: dict[tuple[str, bool], Sequence[str]]) -> DataFrame:
    """Rows (keys, kind, backwards, rule, i, v) of ``slope_reversals`` of each (kind, backwards) under all and each of its rules; ``last`` stands for the first one seen backwards."""
    w = over(keys, ["i"])
    x = rows.withColumns({"__before": F.col("v") - F.lag("v").over(w), "__after": F.lead("v").over(w) - F.col("v")})
    found = {kind: turn(*kind, F.col("__before"), F.col("__after")) for kind in rules}
    seen = {kind: [("last" if kind[1] and r == "first" else r) for r in own] for kind, own in rules.items()}
    return every_rule(x, keys, found, seen, ("kind", "backwards")).withColumn("rule", F.when(F.col("backwards") & (F.col("rule") == "last"), "first").otherwise(F.col("rule")))


def ruled_crossings(rows: DataFrame, keys: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """Rows (keys, kind, rule, i, v) of ``zero_crossings`` of each kind under the rules all, first and last."""
    after, whole_key, end = F.lead("v").over(over(keys, ["i"])), over(keys), F.max("i").over(over(keys))
    x = rows.withColumns({"__after": after, "__end": F.col("i") == end})
    # the last row of a key stands for the place behind the end, where a kind has no crossing
    x = x.withColumns({f"__c_{k}": F.coalesce(crossing(k, F.col("v"), F.col("__after")), F.lit(False)) for k in kinds})
    x = x.withColumns({f"__none_{k}": ~F.max(f"__c_{k}").over(whole_key) & F.col("__end") for k in kinds})
    for k in kinds:
        for rule, side in (("first", F.min), ("last", F.max)):
            x = x.withColumn(f"__{rule}_{k}", side(F.when(F.col(f"__c_{k}"), F.col("i"))).over(whole_key))
    rows_of = lambda k: [
        F.when(F.col(f"__c_{k}"), F.struct(F.lit(k).alias("kind"), F.lit("all").alias("rule"), F.col("i").alias("i"))),
        *[F.when(F.col(f"__c_{k}") & (F.col(f"__{r}_{k}") == F.col("i")), F.struct(F.lit(k).alias("kind"), F.lit(r).alias("rule"), F.col("i").alias("i"))) for r in ("first", "last")],
        F.when(F.col(f"__none_{k}"), F.struct(F.lit(k).alias("kind"), F.lit("last").alias("rule"), (F.col("i") + 1).alias("i"))),
    ]
    hits = F.filter(F.array(*[h for k in kinds for h in rows_of(k)]), lambda h: h.isNotNull())
    return x.select(*keys, "v", F.explode(hits).alias("__h")).select(*keys, "__h.*", "v")


def search_windows(rows: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """The samples of windows of ``width`` samples that overlap by two, with their ``window``; only whole windows."""
    step = width - 2
    last = F.floor(F.col("i") / step)
    first = F.when((F.col("i") % step < 2) & (last > 0), last - 1).otherwise(last)
    out = rows.withColumn("__n", F.count("*").over(over(keys))).withColumn("window", F.explode(F.sequence(first, last)))
    return out.where(F.col("window") * step + width <= F.col("__n")).drop("__n")


def feet(rows: DataFrame, peaks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, i, v): the least sample between consecutive peaks, the first of equals."""
    cut = cycles(rows, peaks, keys)
    low = cut.groupBy(*keys, "cycle").agg(F.min_by(F.struct("i", "v"), F.struct("v", "i")).alias("__x"), F.max("__whole").alias("__whole"))
    return low.where("__whole").select(*keys, "__x.*")


def cycles(rows: DataFrame, marks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The samples from each mark to the next, with ``cycle`` from 1 on; ``__whole`` where there is a next one."""
    at = marks.select(*keys, F.col("i").alias("i"), F.lit(1).alias("__m"))
    marked = rows.join(at, [*keys, "i"], "left").withColumn("cycle", F.sum(F.coalesce("__m", F.lit(0))).over(reach_back(keys, ["i"])))
    return marked.withColumn("__whole", F.col("cycle") < F.max("cycle").over(over(keys))).where("cycle > 0").drop("__m")


#: Landmarks of a pulse: of the wave, of its first derivative, of its second one.
PULSE = "onset systolic notch diastolic vpg_w vpg_y vpg_z apg_a apg_b apg_c apg_d apg_e".split()


def pulse_landmarks(rows: DataFrame, onsets: DataFrame, keys: Sequence[str], w_share: float = 0.5, y_share: float = 0.45, a_share: float = 0.45) -> DataFrame:
    """One row per pulse between two onsets, with the places of its landmarks, its ``stop`` (the next onset) and its ``wave``.

    The w and a waves count only above a share of the key's highest slope and
    acceleration, y only below a share of its lowest slope.  The notch is the e wave,
    the diastolic peak the first one behind it.
    """
    t = over(keys, ["i"])
    middle = lambda c: (F.lead(c).over(t) - F.lag(c).over(t)) / 2
    x = cycles(rows, onsets, keys)
    x = x.withColumn("vpg", middle("v"))
    x = x.withColumn("apg", middle("vpg"))
    x = x.withColumns(
        {
            "__turn": (F.col("apg") > F.lag("apg").over(t)) & (F.col("apg") >= F.lead("apg").over(t)),
            "__pit": (F.col("apg") < F.lag("apg").over(t)) & (F.col("apg") <= F.lead("apg").over(t)),
            "__fall": (F.col("vpg") > 0) & (F.lead("vpg").over(t) <= 0),
            "__up": F.max("vpg").over(over(keys)), "__down": F.min("vpg").over(over(keys)), "__acc": F.max("apg").over(over(keys)),
        }
    ).where("__whole")
    i, pulse, c = F.col("i"), over([*keys, "cycle"]), F.col
    top = lambda x, where: F.max_by(F.when(where, i), F.when(where & c(x).isNotNull(), F.struct(x, -i))).over(pulse)
    low = lambda x, where: F.min_by(F.when(where, i), F.when(where & c(x).isNotNull(), F.struct(x, i))).over(pulse)
    first = lambda where: F.min(F.when(where, i)).over(pulse)
    x = x.withColumns({"onset": F.min("i").over(pulse), "systolic": top("v", F.lit(True)), "stop": F.max("i").over(pulse) + 1})
    rising = i <= c("systolic")
    x = x.withColumns(
        {
            "vpg_w": top("vpg", rising & (c("vpg") >= w_share * c("__up"))),
            "apg_a": top("apg", c("__turn") & rising & (c("apg") >= a_share * c("__acc"))),
            "apg_e": top("apg", c("__turn") & (i > c("systolic"))),
        }
    )
    x = x.withColumns({"notch": c("apg_e"), "apg_b": first(c("__pit") & (i > F.coalesce("apg_a", "onset"))), "diastolic": first(c("__fall") & (i >= c("apg_e")))})
    x = x.withColumns(
        {
            "vpg_y": low("vpg", i.between(c("systolic"), c("notch")) & (c("vpg") <= y_share * c("__down"))),
            "vpg_z": top("vpg", i >= c("notch")),
            "apg_c": first(c("__turn") & (i > c("apg_b")) & (i < c("apg_e"))),
        }
    )
    x = x.withColumn("apg_d", first(c("__pit") & (i > F.greatest("apg_b", "apg_c")) & (i < c("apg_e"))))
    out = x.groupBy(*keys, "cycle").agg(*[F.max(n).alias(n) for n in PULSE], F.max("stop").alias("stop"), F.sort_array(F.collect_list(F.struct("i", "v"))).alias("__wave"))
    return out.withColumn("wave", F.col("__wave.v")).drop("__wave")


def pulse_rows(landmarks: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Landmarks as ``beats.pulse_features`` takes them: the wave up to the next onset, and places in it."""
    ends = landmarks.join(rows.select(*keys, F.col("i").alias("stop"), F.col("v").alias("__last")), [*keys, "stop"])
    inside = [(F.col(k) - F.col("onset")).alias(n) for k, n in (("systolic", "S"), ("notch", "N"), ("diastolic", "D"), ("vpg_w", "w"), ("apg_c", "c"))]
    return ends.select(*keys, "cycle", "onset", F.concat("wave", F.array("__last")).alias("wave"), *inside)


def pulse_class(landmarks: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The class of each key's pulses by the median heights of notch and diastolic peak, which differ by less than 10 % in class 2.

    Class 1 has the peak more than that above the notch, class 3 below; exactly 10 % is unknown.  Keys without a
    diastolic peak have a null class.
    """
    marks = landmarks.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("i")) for k, c in (("N", "notch"), ("D", "diastolic"))])).alias("__m")).select(*keys, "__m.*").where("i is not null")
    at = marks.join(rows, [*keys, "i"]).groupBy(*keys).agg(*[F.percentile(F.when(F.col("k") == k, F.col("v")), 0.5).alias(k) for k in "ND"])
    change = F.abs(100 * safe_div(F.col("D") - F.col("N"), "N"))
    kind = F.when((F.col("D") > F.col("N")) & (change > 10), "Class1").when(change < 10, "Class2").when((F.col("D") < F.col("N")) & (change > 10), "Class3").otherwise("Unknown")
    return at.select(*keys, F.when(F.col("D").isNotNull(), kind).alias("ppg_class"))


def arrival_times(r: DataFrame, onsets: DataFrame, keys: Sequence[str], fs: float, cardiac_ms: DataFrame, most: float = 0.85) -> DataFrame:
    """Rows (keys, i, pat_ms, dpat_ms): from each R peak to the next pulse onset, below ``most`` of the key's median interval.

    ``cardiac_ms`` has the keys and ``interval_ms``; ``dpat_ms`` is the difference to the arrival before.
    """
    both = r.select(*keys, "i", F.lit(0).alias("__k")).unionByName(onsets.select(*keys, "i", F.lit(1).alias("__k")))
    # an onset at the place of the peak is not behind it
    both = both.withColumn("__o", F.when(F.col("__k") == 1, F.col("i")))
    following = F.last("__o", ignorenulls=True).over(over(keys, [F.desc("i"), "__k"]).rowsBetween(Window.unboundedPreceding, -1))
    found = both.withColumn("pat_ms", (following - F.col("i")) * 1000.0 / fs).where("__k = 0 and pat_ms > 0")
    kept = found.join(cardiac_ms.select(*keys, "interval_ms"), list(keys)).where(F.col("pat_ms") < most * F.col("interval_ms"))
    return kept.select(*keys, "i", "pat_ms", (F.col("pat_ms") - F.lag("pat_ms").over(over(keys, ["i"]))).alias("dpat_ms"))


def intervals_ms(peaks: DataFrame, keys: Sequence[str], fs: float, name: str = "rr") -> DataFrame:
    """Rows (keys, i, name) of the intervals between consecutive peaks."""
    return peaks.withColumn(name, (F.col("i") - F.lag("i").over(over(keys, ["i"]))) * 1000.0 / fs).where(F.col(name).isNotNull()).select(*keys, "i", name)


def derived_breaths(peaks: DataFrame, keys: Sequence[str], fs: float, least_s: float = 2.0) -> DataFrame:
    """Rows (keys, i) of breaths seen in the heart rate: its local maxima (over three beats) at least ``least_s`` apart."""
    rate = intervals_ms(peaks, keys, fs).withColumn("r", 60_000.0 / F.nullif(F.col("rr"), F.lit(0.0)))
    smooth = rate.withColumn("v", F.avg("r").over(over(keys, ["i"]).rowsBetween(-1, 1)))
    return spaced_peaks(smooth.select(*keys, "i", "v"), keys, max(1, round(least_s * fs))).select(*keys, "i")


def breathing(resp: DataFrame, edr: DataFrame, pdr: DataFrame, keys: Sequence[str], fs: float) -> DataFrame:
    """Rows (keys, i, source, resp_width_PPresp_s, resp_rate_Bpm) from the first source with two breaths: belt, then ECG, then pulse."""
    sources = ("RESP", "EDR", "PDR")
    all_ = None
    for rank, (name, df) in enumerate(zip(sources, (resp, edr, pdr), strict=True)):
        own = df.select(*keys, "i", F.lit(rank).alias("__r"), F.lit(name).alias("source"))
        all_ = own if all_ is None else all_.unionByName(own)
    usable = all_.withColumn("__n", F.count("*").over(over([*keys, "__r"]))).where("__n >= 2").withColumn("__best", F.min("__r").over(over(keys))).where("__r = __best")
    width = (F.col("i") - F.lag("i").over(over(keys, ["i"]))) / fs
    out = usable.withColumn("resp_width_PPresp_s", width).where(F.col("resp_width_PPresp_s").isNotNull())
    return out.select(*keys, "i", "source", "resp_width_PPresp_s", safe_div(F.lit(60.0), "resp_width_PPresp_s").alias("resp_rate_Bpm"))


def ecg_landmarks(rows: DataFrame, r: DataFrame, keys: Sequence[str], fs: float) -> DataFrame:
    """One row per R peak with the places of its P, QRS and T waves, and the R-R interval before it.

    Each wave is the extreme of a stretch around the R peak (in seconds): Q and S
    the least within 0.1 before and behind; the QRS complex begins and ends at
    the highest sample within 0.04 before Q and 0.06 behind S; P is the highest
    from 0.24 before R to the complex, T from the complex to 0.45 behind R (0.6 of
    the interval, if less); their ends are the least samples beside them, within 0.1 and 0.16.
    """
    s = lambda x: max(1, round(x * fs))
    w = over(keys, ["i"])
    beats = r.select(*keys, F.col("i").alias("R"), (F.col("i") - F.lag("i").over(w)).alias("rr"), F.lead("i").over(w).alias("__next"))
    reach = F.col("R") + F.least(F.lit(s(0.45)), F.coalesce(F.floor(0.6 * (F.col("__next") - F.col("R"))), F.lit(s(0.45)))).cast("int")
    # samples meet their beats by blocks of places, not by comparing all with all
    block = s(0.45) + s(0.16) + s(0.34) + 1
    beats = beats.withColumn("__stop", reach).withColumn("__b", F.explode(F.sequence(F.floor((F.col("R") - s(0.34)) / block), F.floor((F.col("R") + s(0.45) + s(0.16)) / block))))
    x = rows.withColumn("__b", F.floor(F.col("i") / block)).join(beats, [*keys, "__b"])
    x = x.where(F.col("i").between(F.col("R") - s(0.34), F.col("R") + s(0.45) + s(0.16)))
    i, beat = F.col("i"), over([*keys, "R"])
    top = lambda a, b: F.max_by(F.when(i.between(a, b), i), F.when(i.between(a, b), F.struct("v", -i))).over(beat)
    low = lambda a, b: F.min_by(F.when(i.between(a, b), i), F.when(i.between(a, b), F.struct("v", i))).over(beat)
    R = F.col("R")
    x = x.withColumns({"Q": low(R - s(0.1), R), "S": low(R, R + s(0.1))})
    x = x.withColumns({"R_on": top(F.col("Q") - s(0.04), F.col("Q")), "R_off": top(F.col("S"), F.col("S") + s(0.06))})
    x = x.withColumns({"P": top(R - s(0.24), F.col("R_on") - 1), "T": top(F.col("R_off") + 1, F.col("__stop"))})
    x = x.withColumns({"P_on": low(F.col("P") - s(0.1), F.col("P")), "P_off": low(F.col("P"), F.col("R_on")), "T_on": low(F.col("R_off"), F.col("T")), "T_off": low(F.col("T"), F.col("T") + s(0.16))})
    names = "Q S R_on R_off P P_on P_off T T_on T_off".split()
    return x.groupBy(*keys, "R").agg(F.max("rr").alias("rr"), *[F.max(n).alias(n) for n in names])


#: Features of the ECG intervals and the mean in ms from which on a key's values are no longer taken.
GATES = {"pr_interval_ms": 400, "pr_segment_ms": 300, "st_interval_ms": 700, "st_segment_ms": 400, "qt_interval_ms": 900, "qtc_interval_ms": 900}


def ecg_intervals(landmarks: DataFrame, keys: Sequence[str], fs: float) -> DataFrame:
    """Durations (samples), intervals and segments (ms) of each beat, QT also by Fridericia, and the systoles of atria and ventricles.

    An interval whose mean over the key reaches its gate is null throughout.
    """
    ms = lambda b, a: F.when(F.col(b) >= F.col(a), (F.col(b) - F.col(a)) * 1000.0 / fs)
    qt = ms("T_off", "R_on")
    second = F.col("rr") / fs
    out = landmarks.withColumns(
        {
            "P_duration": F.col("P_off") - F.col("P_on"), "QRS_duration": F.col("R_off") - F.col("R_on"), "T_duration": F.col("T_off") - F.col("T_on"),
            "atrialSys_phase": ms("R", "P"), "ventSys_phase": ms("T_off", "R"),
            "pr_interval_ms": ms("R_on", "P_on"), "pr_segment_ms": ms("R_on", "P_off"), "st_interval_ms": ms("T_off", "R_off"), "st_segment_ms": ms("T_on", "R_off"),
            "qt_interval_ms": F.when(F.col("rr").isNotNull(), qt), "qtc_interval_ms": F.when(F.col("rr") > 0, qt / F.cbrt(second)),
            "T_rr_ms": F.col("rr") * 1000.0 / fs, "HR_bpm": safe_div(F.lit(60.0 * fs), "rr"),
        }
    )
    gated = {c: F.when(F.avg(c).over(over(keys)) < most, F.col(c)) for c, most in GATES.items()}
    names = "P_duration QRS_duration T_duration atrialSys_phase ventSys_phase".split() + [*GATES, "T_rr_ms", "HR_bpm"]
    return out.withColumns(gated).select(*keys, F.col("R").alias("i"), *names)


def flat_share(rows: DataFrame, keys: Sequence[str], run: int) -> DataFrame:
    """Rows with ``flat`` where a sample lies in at least ``run`` equal differences of 0, and ``share`` of such samples in the key.

    A channel is left out where 0.8 or more of it is flat; elsewhere the flat samples stand for the median.
    """
    w = over(keys, ["i"])
    x = rows.withColumn("__z", F.coalesce(F.col("v") == F.lag("v").over(w), F.lit(False)))
    x = x.withColumn("__new", F.coalesce((F.col("__z") != F.lag("__z").over(w)).cast("int"), F.lit(1))).withColumn("__r", F.sum("__new").over(reach_back(keys, ["i"])))
    x = x.withColumn("__long", F.col("__z") & (F.count("*").over(over([*keys, "__r"])) >= run))
    # the sample before the first equal difference belongs to the stretch
    x = x.withColumn("flat", F.col("__long") | F.coalesce(F.lead("__long").over(w), F.lit(False)))
    return x.withColumn("share", F.avg(F.col("flat").cast("int")).over(over(keys))).select(*rows.columns, "flat", "share")


def usable(rows: DataFrame, keys: Sequence[str], fs: float, most: float = 0.8) -> DataFrame:
    """Keys with less than ``most`` of flat stretches of a second, whose flat samples become the key's median."""
    x = flat_share(rows, keys, max(1, round(fs))).withColumn("__m", F.percentile("v", 0.5).over(over(keys)))
    return x.where(F.col("share") < most).withColumn("v", F.when(F.col("flat"), F.col("__m")).otherwise(F.col("v"))).select(*rows.columns)
