"""Point-wise signal operators that need no Python (inventory 2.9 W1, W12-W20; 2.11 K10-K19; 2.12)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import over, safe_div, whole
from .stats import quantile_bounds


def sigma_clip(df: DataFrame, keys: Sequence[str], value: str, k: float = 6.0, fill: str = "median") -> DataFrame:
    """Values further than k population deviations from their series' mean become its median (or null); adds ``clipped``."""
    w = over(keys)
    v = F.col(value)
    far = F.abs(v - F.avg(v).over(w)) > k * F.stddev_pop(v).over(w)
    marked = df.withColumn("clipped", F.coalesce(far, F.lit(False))).withColumn("__median", F.percentile(v, 0.5).over(w))
    new = F.when(F.col("clipped"), F.col("__median") if fill == "median" else F.lit(None).cast("double")).otherwise(v)
    return marked.withColumn(value, new).drop("__median")


def iqr_to_null(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    """Values outside the global quartile bounds become null; the bounds are one row per column."""
    bounds = quantile_bounds(df, columns, k)
    wide = bounds.groupBy().agg(*[F.max(F.when(F.col("feature") == c, F.col(b))).alias(f"__{b}_{c}") for c in columns for b in ("low", "high")])
    joined = df.crossJoin(F.broadcast(wide))  # the one row of bounds
    out = joined.withColumns({c: F.when(F.col(c).between(F.col(f"__low_{c}"), F.col(f"__high_{c}")), F.col(c)) for c in columns})
    return out.select(*df.columns)


def median_filter(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, width: int = 15, out: str = "smooth") -> DataFrame:
    """Running median of ``width`` neighbours; at the edges of those that exist."""
    half = width // 2
    return df.withColumn(out, F.percentile(value, 0.5).over(over(keys, order).rowsBetween(-half, half)))


def gradient(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Central differences, one-sided at the edges."""
    w = over(keys, order)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    return df.withColumn(out, F.when(before.isNull(), after - F.col(value)).when(after.isNull(), F.col(value) - before).otherwise((after - before) / 2))


def is_peak(keys: Sequence[str], order: Sequence[str], value: str, height: float | None) -> Column:
    w = over(keys, order)
    v = F.col(value)
    peak = (v > F.lag(v).over(w)) & (v >= F.lead(v).over(w))
    return F.coalesce(peak if height is None else peak & (v >= height), F.lit(False))


def local_peaks(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, height: float | None = None) -> DataFrame:
    """Samples above the one before and not below the one after."""
    return df.withColumn("__peak", is_peak(keys, order, value, height)).where("__peak").drop("__peak")


def troughs(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, height: float | None = None) -> DataFrame:
    """The least sample of each stretch between consecutive peaks, the first of equals."""
    marked = df.withColumn("__peak", is_peak(keys, order, value, height).cast("int"))
    cycled = marked.withColumn("cycle", F.sum("__peak").over(over(keys, order))).withColumn("__cycles", F.sum("__peak").over(over(keys)))
    inside = cycled.where((F.col("cycle") > 0) & (F.col("cycle") < F.col("__cycles")))
    picked = inside.groupBy(*keys, "cycle").agg(F.min_by(F.struct(*[c for c in order if c not in keys], value), F.struct(value, *order)).alias("__s"))
    return picked.select(*keys, "cycle", "__s.*")


def refine_peaks(df: DataFrame, keys: Sequence[str], t: str, row_id: str, value: str, reach: int, height: float | None = None) -> DataFrame:
    """Each peak's highest sample within ``reach`` of its time, by a range window."""
    w = over(keys, [t]).rangeBetween(-reach, reach)
    best = F.max(F.struct(F.col(value).alias("v"), (-F.col(t)).alias("t"), (-F.col(row_id)).alias("i"))).over(w)
    marked = df.withColumn("__peak", is_peak(keys, [t, row_id], value, height)).withColumn("__best", best)
    return marked.where("__peak").select(*keys, row_id, (-F.col("__best.i")).alias("refined_id"), F.col("__best.v").alias(value))


def zero_crossings(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, demean: bool = True) -> DataFrame:
    """Samples after which the (demeaned) series changes its sign, with the direction.

    The mean is summed in the order of the series: in the order of a shuffle its last bit, and so the sign of a value at the mean, would differ between runs.
    """
    x = F.col(value) - F.avg(value).over(whole(keys, order)) if demean else F.col(value)
    rows = df.withColumn("__x", x).withColumn("__next", F.lead("__x").over(over(keys, order)))
    up, down = (F.col("__x") < 0) & (F.col("__next") >= 0), (F.col("__x") >= 0) & (F.col("__next") < 0)
    return rows.withColumn("direction", F.when(up, "positive").when(down, "negative")).where("direction is not null").drop("__x", "__next")


def trapezoid(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, t: str, unit: float) -> DataFrame:
    """Area by trapezoids over the sample index (area_unit) and over time in ``unit`` (area)."""
    w = over(keys, order)
    rows = df.withColumn("__mean", (F.col(value) + F.lead(value).over(w)) / 2).withColumn("__dt", (F.lead(t).over(w) - F.col(t)) / F.lit(unit))
    return rows.groupBy(*keys).agg(F.sum("__mean").alias("area_unit"), F.sum(F.col("__mean") * F.col("__dt")).alias("area"))


def intervals(df: DataFrame, keys: Sequence[str], order: Sequence[str], t: str, unit: float, slack: float | None = None, scale: float = 60.0) -> DataFrame:
    """Intervals between successive events and their rate; those ``slack`` or more above the median go."""
    rows = df.withColumn("interval", (F.col(t) - F.lag(t).over(over(keys, order))) / F.lit(unit))
    if slack is not None:
        rows = rows.withColumn("__median", F.percentile("interval", 0.5).over(over(keys))).where(F.col("interval") < F.col("__median") + slack).drop("__median")
    return rows.withColumn("rate", safe_div(F.lit(scale), "interval"))


def positional_correlation(df: DataFrame, keys: Sequence[str], order: Sequence[str], channel: str, left: str, right: str, value: str, n: int) -> DataFrame:
    """Correlation of the first n samples of two channels, paired by position."""
    chosen = df.where(F.col(channel).isin(left, right)).withColumn("__i", F.row_number().over(over([*keys, channel], order))).where(F.col("__i") <= n)
    paired = chosen.groupBy(*keys, "__i").agg(*[F.max(F.when(F.col(channel) == c, F.col(value))).alias(a) for c, a in ((left, "__a"), (right, "__b"))])
    return paired.where("__a is not null and __b is not null").groupBy(*keys).agg(F.corr("__a", "__b").alias("score"), F.count("*").alias("n")).where(F.col("n") == n)


def template_scores(beats: DataFrame, row_id: str, group: str, values: str) -> DataFrame:
    """Pearson correlation of each beat (an array) with the mean beat of its group."""
    long_ = beats.select(row_id, group, F.posexplode(values).alias("__i", "__v")).withColumn("__v", F.col("__v").cast("double"))
    template = long_.groupBy(group, "__i").agg(F.avg("__v").alias("__m"))
    return long_.join(template, [group, "__i"]).groupBy(row_id, group).agg(F.corr("__v", "__m").alias("score"))


def beat_quality(scores: DataFrame, group: str, score: str = "score", low: float = 0.8) -> DataFrame:
    """Mean correlation of each group's beats with their template, and the share of beats below ``low``."""
    return scores.groupBy(group).agg(F.count(score).alias("beats"), F.avg(score).alias("mean_corr"), F.avg((F.col(score) < low).cast("int")).alias("low_share"))


def keep_beats(df: DataFrame, keys: Sequence[str], order: Sequence[str], t: str, score: str, unit: float, least_score: float, low: float, high: float) -> DataFrame:
    """Beats whose score exceeds a limit and whose rate is in range; the first beat has the second one's rate."""
    w = over(keys, order)
    gap = (F.col(t) - F.lag(t).over(w)) / F.lit(unit)
    rows = df.withColumn("__gap", gap).withColumn("__gap", F.coalesce("__gap", F.lead("__gap").over(w)))
    return rows.withColumn("rate", safe_div(F.lit(60.0), "__gap")).where((F.col(score) > least_score) & F.col("rate").between(low, high)).drop("__gap")


def flat_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, least: int) -> DataFrame:
    """Runs of at least ``least`` samples with one value: keys, value, first and last row number, length."""
    w = over(keys, order)
    rows = df.withColumn("__i", F.row_number().over(w)).withColumn("__new", F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(1)))
    rows = rows.withColumn("__island", F.sum("__new").over(w))
    runs = rows.groupBy(*keys, "__island").agg(F.first(value).alias("value"), F.min("__i").alias("first"), F.max("__i").alias("last"), F.count("*").alias("length"))
    return runs.where(F.col("length") >= least).drop("__island")


def within_deviations(df: DataFrame, keys: Sequence[str], value: str, k: float = 3.0) -> DataFrame:
    """Only the points whose value lies within k population deviations of their key's mean."""
    w = over(keys)
    near = F.abs(F.col(value) - F.avg(value).over(w)) <= k * F.stddev_pop(value).over(w)
    return df.withColumn("__near", near).where("__near").drop("__near")


def outliers_filled(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, k: float = 3.0) -> DataFrame:
    """Values further than k deviations from their key's mean become the value before them, or else the one after."""
    from .windows import fill_both_ways

    return fill_both_ways(sigma_clip(df, keys, value, k, fill="null"), keys, order, [value])


def not_blank(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text is more than white space."""
    return df.where(F.trim(F.col(column)) != "")
