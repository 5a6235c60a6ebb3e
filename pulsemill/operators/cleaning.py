"""Missingness, imputation, scaling and feature selection (inventory 2.5, 2.14 M1-M10)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean_double, safe_div
from .stats import correlation_pairs, exact_quantiles


def to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NaN and infinities become null."""
    return df.withColumns({c: clean_double(c) for c in columns})


def null_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (feature, nulls, share): one pass over the table for all columns."""
    rows = [F.struct(F.lit(c).alias("feature"), F.sum(F.col(c).isNull().cast("int")).alias("nulls"), F.avg(F.col(c).isNull().cast("int")).alias("share")) for c in columns]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def missingness_report(df: DataFrame, columns: Sequence[str], thresholds: Sequence[float] = (0.3, 0.6, 1.0)) -> DataFrame:
    """Missing percentage of each column and its risk: Low, Moderate or High by the upper bounds."""
    shares = null_shares(df, columns)
    risk = F.when(F.col("share") <= thresholds[0], "Low").when(F.col("share") <= thresholds[1], "Moderate").when(F.col("share") <= thresholds[2], "High")
    return shares.select("feature", "nulls", F.round(F.col("share") * 100, 2).alias("missing_pct"), risk.alias("risk"))


def sparse_columns(df: DataFrame, columns: Sequence[str], share: float) -> list[str]:
    """Columns that are missing in at least this share of the rows: a scalar per column comes to the driver."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] is not None and row[c] >= share]


def row_null_share(columns: Sequence[str]):
    total = F.lit(0)
    for c in columns:
        total = total + F.col(c).isNull().cast("int")
    return total / F.lit(float(max(len(columns), 1)))


def drop_sparse(df: DataFrame, columns: Sequence[str], first: float = 0.85, rows: float = 0.80, then: float = 0.15) -> tuple[DataFrame, list[str]]:
    """Drops columns missing in ``first`` of the rows, then rows missing more than ``rows`` of the rest, then columns missing in ``then``."""
    gone = set(sparse_columns(df, columns, first))
    kept = [c for c in columns if c not in gone]
    out = df.drop(*gone).where(row_null_share(kept) <= rows)
    late = set(sparse_columns(out, kept, then))
    return out.drop(*late), [c for c in kept if c not in late]


def median_impute(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values become the column's exact median."""
    medians = {r.feature: r.q0 for r in exact_quantiles(df, columns, (0.5,)).collect()}  # a row per column
    return df.fillna({c: m for c, m in medians.items() if m is not None})


def mode_impute(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values become the column's most frequent value, the least of equals."""
    counts = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    counts = counts.where("v is not null").groupBy("c", "v").agg(F.count("*").alias("n"))
    modes = {r.c: r.v for r in counts.groupBy("c").agg(F.min_by("v", F.struct(-F.col("n"), "v")).alias("v")).collect()}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(modes[c]).cast(df.schema[c].dataType)) for c in columns if c in modes})


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Zero mean and unit population deviation; constants become 0."""
    s = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns]).first()
    return df.withColumns({c: (F.col(c) - s[c].m) / F.lit(s[c].s or 1.0) for c in columns if s[c].m is not None})


def min_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scaled to [0, 1]; constants become 0."""
    s = df.agg(*[F.struct(F.min(c).alias("a"), F.max(c).alias("b")).alias(c) for c in columns]).first()
    return df.withColumns({c: (F.col(c) - s[c].a) / F.lit(float(s[c].b - s[c].a) or 1.0) for c in columns if s[c].a is not None})


def variances(df: DataFrame, columns: Sequence[str], threshold: float = 0.01) -> DataFrame:
    """Population variance of each column and whether it exceeds the threshold."""
    rows = [F.struct(F.lit(c).alias("feature"), F.var_pop(c).alias("variance")) for c in columns]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows")).withColumn("kept", F.col("variance") > threshold)


def correlation_filter(df: DataFrame, columns: Sequence[str], threshold: float = 0.9) -> DataFrame:
    """Columns kept by the greedy filter: one goes if any earlier column (itself kept or not) correlates above the threshold."""
    bad = correlation_pairs(df, columns).where(F.abs("r") > threshold).select(F.col("right").alias("feature")).distinct()
    named = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(columns)], "position int, feature string")
    return named.join(bad.withColumn("__bad", F.lit(True)), "feature", "left").select("position", "feature", F.col("__bad").isNull().alias("kept"))


def select_features(df: DataFrame, columns: Sequence[str], scale: str = "standard", variance: float = 0.01, correlation: float = 0.85) -> tuple[DataFrame, list[str]]:
    """Scaling, variance filter and correlation filter in that order; the chosen columns and their names."""
    scaled = standardise(df, columns) if scale == "standard" else min_max(df, columns)
    varied = [r.feature for r in variances(scaled, columns, variance).where("kept").collect()]
    varied = [c for c in columns if c in set(varied)]
    if len(varied) > 1:
        good = {r.feature for r in correlation_filter(scaled, varied, correlation).where("kept").collect()}
        varied = [c for c in varied if c in good]
    return scaled.select(*[c for c in df.columns if c not in columns], *varied), varied


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 of each class, null where undefined."""
    classes = df.select(F.explode(F.array(F.struct(F.col(label).alias("c"), F.lit(1).alias("l"), (F.col(label) == F.col(predicted)).cast("int").alias("h"), F.lit(0).alias("p")),
                                          F.struct(F.col(predicted).alias("c"), F.lit(0).alias("l"), F.lit(0).alias("h"), F.lit(1).alias("p")))).alias("x")).select("x.*")
    out = classes.where("c is not null").groupBy(F.col("c").alias("cls")).agg(F.sum("l").alias("support"), F.sum("h").alias("hits"), F.sum("p").alias("predicted"))
    out = out.withColumn("precision", safe_div("hits", "predicted")).withColumn("recall", safe_div("hits", "support"))
    return out.withColumn("f1", safe_div(2 * F.col("hits"), F.col("support") + F.col("predicted")))


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """MSE, MAE, R squared and Pearson correlation."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    both = df.where(y.isNotNull() & p.isNotNull())
    mse = F.avg((y - p) * (y - p))
    return both.agg(mse.alias("mse"), F.avg(F.abs(y - p)).alias("mae"), (1 - mse / F.nullif(F.var_pop(y), F.lit(0.0))).alias("r2"), F.corr(y, p).alias("pearson"))


def bland_altman(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Mean difference and its limits of agreement (1.96 population deviations)."""
    d = F.col(actual).cast("double") - F.col(predicted).cast("double")
    out = df.agg(F.avg(d).alias("mean_diff"), F.stddev_pop(d).alias("sd"))
    return out.select("mean_diff", (F.col("mean_diff") - 1.96 * F.col("sd")).alias("low"), (F.col("mean_diff") + 1.96 * F.col("sd")).alias("high"))


def most_frequent(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """The most frequent value of each named column, the least of equals."""
    return df.agg(*[F.mode(c, True).alias(n) for n, c in columns.items()])
