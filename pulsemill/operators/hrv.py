"""Heart-rate variability and beat features in DataFrame form (inventory 2.12, 2.13; published definitions)."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import over, reach_back, safe_div


def nn_intervals(beats: DataFrame, keys: Sequence[str], order: Sequence[str], t: str, unit: float) -> DataFrame:
    """Intervals ``nn`` between beats and their successive differences ``d``."""
    w = over(keys, order)
    rows = beats.withColumn("nn", (F.col(t) - F.lag(t).over(w)) / F.lit(unit)).where("nn is not null")
    return rows.withColumn("d", F.col("nn") - F.lag("nn").over(w))


def time_domain(nn: DataFrame, keys: Sequence[str], steps: tuple[float, float] = (50.0, 20.0), bin_width: float = 7.8125) -> DataFrame:
    """Order statistics, deviations, successive differences and the triangular index of the intervals."""
    w = over(keys)
    rows = nn.withColumn("__q", F.percentile("nn", F.array(*[F.lit(p) for p in (0.2, 0.25, 0.5, 0.75, 0.8)])).over(w)).withColumn("__median", F.col("__q")[2])
    rows = rows.withColumn("__bin", F.floor(F.col("nn") / bin_width))
    rows = rows.withColumn("__in_bin", F.count("*").over(over([*keys, "__bin"])))
    share = lambda x: 100 * F.avg(F.when(F.col("d").isNotNull(), (F.abs("d") > x).cast("int")))
    out = rows.groupBy(*keys).agg(
        F.avg("nn").alias("MeanNN"), F.stddev_samp("nn").alias("SDNN"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("RMSSD"), F.stddev_samp("d").alias("SDSD"),
        F.max("__median").alias("MedianNN"), F.percentile(F.abs(F.col("nn") - F.col("__median")), 0.5).alias("MadNN"),
        F.max(F.col("__q")[3] - F.col("__q")[1]).alias("IQRNN"), F.max(F.col("__q")[0]).alias("Prc20NN"), F.max(F.col("__q")[4]).alias("Prc80NN"),
        share(steps[0]).alias("pNN50"), share(steps[1]).alias("pNN20"), F.min("nn").alias("MinNN"), F.max("nn").alias("MaxNN"), (F.count("nn") / F.max("__in_bin")).alias("HTI"),
    )
    return out.withColumns({"CVNN": safe_div("SDNN", "MeanNN"), "CVSD": safe_div("RMSSD", "MeanNN"), "MCVNN": safe_div("MadNN", "MedianNN"), "SDRMSSD": safe_div("SDNN", "RMSSD")})


def windowed_deviation(nn: DataFrame, keys: Sequence[str], t: str, width: float) -> DataFrame:
    """SDANN and SDNNI: deviation of the window means, mean of the window deviations."""
    windows = nn.groupBy(*keys, F.floor(F.col(t) / F.lit(width)).alias("__w")).agg(F.avg("nn").alias("__m"), F.stddev_samp("nn").alias("__s"))
    return windows.groupBy(*keys).agg(F.stddev_samp("__m").alias("SDANN"), F.avg("__s").alias("SDNNI"))


def windowed_contract(nn: DataFrame, keys: Sequence[str], t: str, minute: float, minutes: Sequence[int] = (1, 2, 5)) -> DataFrame:
    """SDANN and SDNNI of windows of one, two and five minutes; ``minute`` is a minute in the unit of ``t``."""
    out = None
    for m in minutes:
        own = windowed_deviation(nn, keys, t, m * minute).select(*keys, F.col("SDANN").alias(f"SDANN{m}"), F.col("SDNNI").alias(f"SDNNI{m}"))
        out = own if out is None else out.join(own, list(keys))
    return out


def shape(nn: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Asymmetry of the Poincare plot in percent: GI by the distance to the line of identity, SI by the angle, AI by the sector's area, PI by the count below it."""
    x, y = F.lag("nn").over(over(keys, order)), F.col("nn")
    pairs = nn.withColumn("__x", x).where("__x is not null").withColumn("__y", y)
    x, y = F.col("__x"), F.col("__y")
    angle = F.abs(F.lit(pi / 4) - F.atan(y / F.nullif(x, F.lit(0.0))))
    above = lambda v: 100 * safe_div(F.sum(F.when(y > x, v).otherwise(0.0)), F.sum(v))
    below, moved = F.sum((y < x).cast("int")), F.sum((y != x).cast("int"))
    return pairs.groupBy(*keys).agg(above(F.abs(y - x)).alias("GI"), above(angle).alias("SI"), above(angle * (x * x + y * y)).alias("AI"), (100 * safe_div(below, moved)).alias("PI"))


def contributions(asymmetric: DataFrame) -> DataFrame:
    """Adds SDNNd and SDNNa, the parts of the deviation from decelerations and accelerations, and their shares Cd and Ca."""
    part = lambda k: (F.col(f"SD1{k}") * F.col(f"SD1{k}") + F.col(f"SD2{k}") * F.col(f"SD2{k}")) / 2
    return asymmetric.withColumns({"SDNNd": F.sqrt(part("d")), "SDNNa": F.sqrt(part("a")), "Cd": safe_div(part("d"), part("d") + part("a")), "Ca": safe_div(part("a"), part("d") + part("a"))})


def poincare(nn: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SD1, SD2 and what is derived from them."""
    out = nn.groupBy(*keys).agg(F.sqrt(F.var_samp("d") / 2).alias("SD1"), F.sqrt(F.greatest(F.lit(0.0), 2 * F.var_samp("nn") - F.var_samp("d") / 2)).alias("SD2"))
    a, b = F.col("SD1"), F.col("SD2")
    return out.withColumns(
        {"SD1SD2": safe_div("SD1", "SD2"), "S": pi * a * b, "CSI": safe_div("SD2", "SD1"), "CVI": F.when((a > 0) & (b > 0), F.log10(16 * a * b)), "CSI_Modified": safe_div(4 * b * b, "SD1")}
    )


def asymmetry(nn: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Contributions of decelerations and accelerations to short and long-term variability."""
    x, y = F.lag("nn").over(over(keys, order)), F.col("nn")
    pairs = nn.withColumn("__x", x).where("__x is not null").withColumn("__y", y)
    w = over(keys)
    pairs = pairs.withColumn("__dev", (F.col("__x") - F.avg("__x").over(w)) + (F.col("__y") - F.avg("__y").over(w)))
    step = F.col("__y") - F.col("__x")
    short, long_ = step * step / 2, F.col("__dev") * F.col("__dev") / 2
    n1 = F.count("*") - 1
    some = lambda v, c: F.sum(F.when(c, v).otherwise(0.0))
    sums = pairs.groupBy(*keys).agg(
        some(short, step > 0).alias("s_d"), some(short, step < 0).alias("s_a"), (some(long_, step > 0) + some(long_, step == 0) / 2).alias("l_d"), (some(long_, step < 0) + some(long_, step == 0) / 2).alias("l_a"), n1.alias("n1")
    )
    sd = lambda c: F.sqrt(safe_div(c, "n1"))
    both = lambda a, b: F.col(a) + F.col(b)
    return sums.select(
        *keys, safe_div("s_d", both("s_d", "s_a")).alias("C1d"), safe_div("s_a", both("s_d", "s_a")).alias("C1a"), sd("s_d").alias("SD1d"), sd("s_a").alias("SD1a"),
        safe_div("l_d", both("l_d", "l_a")).alias("C2d"), safe_div("l_a", both("l_d", "l_a")).alias("C2a"), sd("l_d").alias("SD2d"), sd("l_a").alias("SD2a"),
    )


def fragmentation(nn: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Inflection share, inverse mean run length, share in short runs, share in long alternation."""
    w = over(keys, order)
    rows = nn.where("d is not null").withColumn("__s", F.signum("d"))
    rows = rows.withColumn("__turn", F.coalesce(((F.col("__s") * F.lag("__s").over(w)) <= 0).cast("int"), F.lit(0)))
    rows = rows.withColumn("__new", F.coalesce((F.col("__s") != F.lag("__s").over(w)).cast("int"), F.lit(1))).withColumn("__run", F.sum("__new").over(w))
    rows = rows.withColumn("__alt", F.coalesce((F.col("__s") * F.lag("__s").over(w) < 0).cast("int"), F.lit(0)))
    rows = rows.withColumn("__chain", F.sum(1 - F.col("__alt")).over(w))
    length = F.count("*").over(over([*keys, "__run"]))
    rows = rows.withColumn("__length", length).withColumn("__chained", F.count("*").over(over([*keys, "__chain"])))
    return rows.groupBy(*keys).agg(
        F.avg("__turn").alias("PIP"), safe_div(F.max("__run").cast("double"), F.count("*")).alias("IALS"), F.avg((F.col("__length") < 3).cast("int")).alias("PSS"), F.avg((F.col("__chained") >= 4).cast("int")).alias("PAS")
    )


def choose_source(first: DataFrame, second: DataFrame, keys: Sequence[str], low: float = 300.0, high: float = 2000.0, share: float = 0.2) -> DataFrame:
    """Which of two interval sources to use: the first unless more than ``share`` of it lies outside the range, then the second."""
    bad = lambda df, n: df.groupBy(*keys).agg(F.avg((~F.col("nn").between(low, high)).cast("int")).alias(n))
    both = bad(first, "first_bad").join(bad(second, "second_bad"), list(keys), "full")
    return both.withColumn("source", F.when(F.col("first_bad") <= share, "first").when(F.col("second_bad") <= share, "second").otherwise("none"))


def clean_intervals(nn: DataFrame, keys: Sequence[str], order: Sequence[str], low: float = 300.0, high: float = 2000.0, ratio: float = 0.2) -> DataFrame:
    """Outliers and ectopic intervals (a change above ``ratio``) become missing and are interpolated linearly by position, then rounded up."""
    w = over(keys, order)
    rows = nn.withColumn("__i", F.row_number().over(w)).withColumn("__v", F.when(F.col("nn").between(low, high), F.col("nn")))
    rows = rows.withColumn("__v", interpolated("__v", "__i", keys))
    ectopic = F.abs(F.col("__v") - F.lag("__v").over(w)) > ratio * F.lag("__v").over(w)
    rows = rows.withColumn("__v", F.when(F.coalesce(ectopic, F.lit(False)), None).otherwise(F.col("__v")))
    return rows.withColumn("clean", F.ceil(interpolated("__v", "__i", keys)).cast("long")).drop("__i", "__v")


def interpolated(value: str, position: str, keys: Sequence[str]) -> Column:
    """Missing values by position between their neighbours; at the ends the nearest value."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(position).alias("p"), F.col(value).alias("v")))
    a, b = (F.last(known, ignorenulls=True).over(reach_back(keys, [position], ahead)) for ahead in (False, True))
    line = a["v"] + (b["v"] - a["v"]) * (F.col(position) - a["p"]) / F.nullif(b["p"] - a["p"], F.lit(0))
    return F.coalesce(F.col(value), line, a["v"], b["v"])


def haemodynamics(df: DataFrame, systolic: str, diastolic: str, rate: str) -> DataFrame:
    """Mean and pulse pressure, cardiac output, resistance and shock index of paired pressures."""
    s, d, hr = F.col(systolic), F.col(diastolic), F.col(rate)
    out = df.withColumns({"MAP": (s + 2 * d) / 3, "PP_ABP": s - d, "ShockIndex": safe_div(rate, systolic)}).withColumn("CO", F.col("PP_ABP") * hr / 1000)
    return out.withColumn("TPR", safe_div("MAP", "CO"))
