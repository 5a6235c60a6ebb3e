"""The sixteen statistics of a series, and other per-series aggregates (inventory 2.6, 2.5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import entropy_of_counts, over, reach_back, safe_div, unpivot
from ..functions.registry import STATISTICS

BINS = 10
#: Parts of the bracket around a quantile.
PARTS = 1024


def histogram_bin(value: Column, low: Column, high: Column, n: Column) -> Column:
    """The equal-width bin of a value, with as many bins as values but ten at most; the last one is closed."""
    bins = F.least(F.lit(BINS), n)
    return F.when(high > low, F.least(F.floor((value - low) * bins / (high - low)), bins - 1)).otherwise(F.lit(0)).cast("int")


def series_stats(samples: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "value", statistics: Sequence[str] = STATISTICS) -> DataFrame:
    """One row per series with the asked statistics; nulls don't count.

    All windows and the final aggregate share one partitioning by ``keys``.
    Definitions: population std, skewness and excess kurtosis; ``mad`` is the mean
    distance to the median; percentiles interpolate; entropy of a histogram;
    slope over 0..n-1; Gini of values shifted to be non-negative.  A statistic
    that needs two values is null for one.
    """
    v = F.col(value).cast("double")
    whole = over(keys)
    rows = samples.where(v.isNotNull() & ~F.isnan(v)).select(*keys, *[F.col(c) for c in order if c not in keys], v.alias("_v"))
    rows = rows.withColumns(
        {
            "_i": F.row_number().over(over(keys, order)) - 1,
            "_prev": F.lag("_v").over(over(keys, order)),
            "_n": F.count("_v").over(whole),
            "_mean": F.avg("_v").over(whole),
            "_low": F.min("_v").over(whole),
            "_high": F.max("_v").over(whole),
            "_q": quartiles(F.col("_v")).over(whole),
        }
    )
    if "gini_index" in statistics:
        rows = rows.withColumn("_rank", F.row_number().over(over(keys, ["_v"])))
    bin_ = histogram_bin(F.col("_v"), F.col("_low"), F.col("_high"), F.col("_n"))
    n = F.count("_v")
    positive = F.col("_v") - F.least(F.col("_low"), F.lit(0.0)) + F.lit(1e-7)
    several = lambda c: F.when(n >= 2, c)
    counts = [F.sum(F.when(bin_ == i, 1).otherwise(0)) for i in range(BINS)]
    d = F.col("_v") - F.col("_mean")
    exprs = {
        "mean": F.avg("_v"),
        "median": F.max(F.col("_q")[1]),
        "std": F.stddev_pop("_v"),
        "mad": F.avg(F.abs(F.col("_v") - F.col("_q")[1])),
        "iqr": F.max(F.col("_q")[2] - F.col("_q")[0]),
        "min": F.min("_v"),
        "max": F.max("_v"),
        "p25": F.max(F.col("_q")[0]),
        "p75": F.max(F.col("_q")[2]),
        "skewness": F.when(F.max("_v") > F.min("_v"), F.skewness("_v")),
        "kurtosis": F.when(F.max("_v") > F.min("_v"), F.kurtosis("_v")),
        "entropy": several(entropy_of_counts(counts, n)),
        "slope": several(F.regr_slope(F.col("_v"), F.col("_i").cast("double"))),
        "autocorr_lag1": several(safe_div(F.sum((F.col("_prev") - F.col("_mean")) * d), F.sum(d * d))),
        "valid_n": n,
    }
    if "gini_index" in statistics:
        exprs["gini_index"] = several(2 * F.sum(F.col("_rank") * positive) / (n * F.sum(positive)) - (n + 1) / n)
    return rows.groupBy(*keys).agg(*[exprs[s].alias(s) for s in statistics])


def wide_stats(stats: DataFrame, keys: Sequence[str], name: str, names: Sequence[str], statistics: Sequence[str] = STATISTICS) -> DataFrame:
    """Long statistics (one row per key and feature) as a wide row with the columns feature_statistic of the contract."""
    pivoted = stats.groupBy(*keys).pivot(name, list(names)).agg(*[F.first(s).alias(s) for s in statistics])
    columns = [f"{n}_{s}" for n in names for s in statistics] if len(statistics) > 1 else list(names)
    return pivoted.select(*keys, *columns)


def quartiles(x: Column) -> Column:
    """The three exact quartiles from one buffer of distinct values."""
    return F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample std, min, exact quartiles and max, a row per column."""
    plain = unpivot(df, [], columns).groupBy("feature").agg(F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    found = exact_quantiles(df, columns, (0.25, 0.5, 0.75))
    return plain.join(F.broadcast(found), "feature", "left").select("feature", "count", "mean", "std", "min", F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75"), "max")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows and share of each value; nulls don't count."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / df.agg(F.count(column)).scalar())


def running_sums(df: DataFrame, by: str, columns: Sequence[str], descending: bool = False, ranges: int = 256, keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``run_c`` for each column c: its sum over all rows of the keys up to this one by the number ``by``, whose values are distinct.

    Rows are dealt to ranges between approximate quantiles; a range is summed up by
    itself, on top of the sums of the ranges before it (a row for each range).
    """
    grid = [i / ranges for i in range(1, ranges)]
    cuts = df.agg(F.percentile_approx(F.col(by).cast("double"), grid, 10_000)).first()[0] or []
    borders = F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<double>")
    ranged = df.withColumn("__r", F.size(F.filter(borders, lambda c: c < F.col(by))))
    before = reach_back(keys, ["__r"], descending, upto=-1)
    held = ranged.groupBy(*keys, "__r").agg(*[F.sum(c).alias(f"__{c}") for c in columns])
    held = held.select(*keys, "__r", *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in columns])
    inside = reach_back([*keys, "__r"], [by], descending)
    return ranged.join(held, [*keys, "__r"]).withColumns({f"run_{c}": F.sum(c).over(inside) + F.col(f"__{c}") for c in columns}).drop("__r", *[f"__{c}" for c in columns])


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of each pair of columns over the rows where both are present, in one pass."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    x = [F.col(c).cast("double") for c in columns]
    # corr of Spark is null-aware per pair only if both are null together
    both = lambda i, j: F.corr(F.when(x[j].isNotNull(), x[i]), F.when(x[i].isNotNull(), x[j]))
    rows = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(columns[i]).alias("left"), F.lit(columns[j]).alias("right"), both(i, j).alias("r")) for i, j in pairs]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], width: float = 0.0005, accuracy: int = 20_000) -> DataFrame:
    """Rows (feature, probs...) of exact interpolated quantiles of whole columns, whatever the number of distinct values.

    A sketch gives a bracket of ranks ``width`` to either side of each quantile,
    wider than its guaranteed error.  A second pass counts the values below the
    bracket and those in each of its PARTS equal parts; only the values of the
    parts that hold the quantile are put in order.
    """
    long_ = unpivot(df, [], columns).where("value is not null")
    grid = [min(max(q, 0.0), 1.0) for p in probs for q in (p - width, p + width)]
    sketch = long_.groupBy("feature").agg(F.count("*").alias("n"), F.percentile_approx("value", grid, accuracy).alias("cuts"), F.min("value").alias("low"), F.max("value").alias("high"))
    brackets = []
    for i, p in enumerate(probs):
        few = F.col("n") * width < 4  # the bracket must hold both neighbours of the quantile
        low = F.when(few | F.lit(p - width <= 0), F.col("low")).otherwise(F.col("cuts")[2 * i])
        high = F.when(few | F.lit(p + width >= 1), F.col("high")).otherwise(F.col("cuts")[2 * i + 1])
        brackets.append(F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"), low.alias("low"), high.alias("high")))
    sketch = sketch.select("feature", "n", F.array(*brackets).alias("brackets"))
    marked = long_.join(F.broadcast(sketch), "feature")  # a row per column
    # values below each bracket are only counted, by one conditional sum a column
    under = marked.groupBy("feature").agg(*[F.sum((F.col("value") < F.col("brackets")[i]["low"]).cast("long")).alias(f"u{i}") for i in range(len(probs))])
    inside = marked.select("feature", "n", "value", F.explode(F.filter("brackets", lambda b: F.col("value").between(b["low"], b["high"]))).alias("b")).select("feature", "n", "value", "b.*")
    part = F.least(F.lit(PARTS - 1), F.floor((F.col("value") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * PARTS))
    counts = inside.groupBy("feature", "n", "i", "p", F.coalesce(part, F.lit(0)).alias("part"), "value").agg(F.count("*").alias("c"))
    # parts of a bracket with their numbers of values; at most PARTS rows for each quantile
    parts = counts.groupBy("feature", "i", "part").agg(F.sum("c").alias("c"))
    below = F.element_at(F.array(*[F.col(f"u{i}") for i in range(len(probs))]), F.col("i") + 1)
    parts = parts.join(F.broadcast(under), "feature").withColumn("before", F.coalesce(F.sum("c").over(reach_back(["feature", "i"], ["part"], upto=-1)), F.lit(0)) + below)
    ranked = counts.join(F.broadcast(parts.select("feature", "i", "part", "before", F.col("c").alias("own"))), ["feature", "i", "part"])
    at = (F.col("n") - 1) * F.col("p")
    ranked = ranked.where((F.col("before") <= F.ceil(at)) & (F.col("before") + F.col("own") > F.floor(at)))
    ranked = ranked.withColumn("upto", F.col("before") + F.sum("c").over(reach_back(["feature", "i", "part"], ["value"])))
    first = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("value")))
    low, high = first(F.floor(at)), first(F.ceil(at))
    share = F.max(at - F.floor(at))
    found = ranked.groupBy("feature", "i").agg((low + share * (high - low)).alias("q"))
    return found.groupBy("feature").agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"q{i}") for i in range(len(probs))])


def quantile_bounds(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    """Rows (feature, low, high): quartiles less and more k interquartile ranges."""
    spread = k * (F.col("q1") - F.col("q0"))
    return exact_quantiles(df, columns, (0.25, 0.75)).select("feature", (F.col("q0") - spread).alias("low"), (F.col("q1") + spread).alias("high"))
