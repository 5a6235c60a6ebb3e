"""Prompts, validation reports, methods text and the export of results (inventory 2.2 SK10, 2.5 A22g, 2.16 R3, R7, R12)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import tables


def prompt(group: Column, size: Column, share: Column, features: Column) -> Column:
    """What a writer, human or model, is asked about a group."""
    return F.concat_ws(
        "\n",
        F.format_string("Cluster %s holds %s patients (%.1f%% of the cohort).", group, size.cast("string"), share),
        F.concat(F.lit("Most important features: "), features, F.lit(".")),
        F.lit("Name the phenotype and interpret it in clinical terms."),
    )


def validation_report(groups: DataFrame, group: str, n: str, rates: Mapping[str, str], medians: Mapping[str, str]) -> DataFrame:
    """A line of text per group: size, rates in percent and medians of the outcomes."""
    parts = [F.format_string("%s: %s patients", F.col(group).cast("string"), F.col(n).cast("string"))]
    parts += [F.format_string(f"{label} %.1f%%", 100 * F.col(c)) for label, c in rates.items()]
    parts += [F.format_string(f"{label} %.1f", F.col(c).cast("double")) for label, c in medians.items()]
    return groups.select(group, F.concat_ws("; ", *parts).alias("line"))


def cross_validation_summary(folds: DataFrame, metric: str, value: str) -> DataFrame:
    """Mean and population deviation of each metric over the folds."""
    return folds.groupBy(metric).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("folds"))


def methods_text(patients: int, features: int, clusters: int, correlation: float, variance: float, resamples: int) -> str:
    """A paragraph on methods from the parameters that were used."""
    return (
        f"Features of {patients:,} encounters were standardised; those with a variance of {variance} or less, or a correlation above {correlation} with an earlier one, "
        f"were removed, which left {features}. {clusters} clusters were formed by consensus over {resamples} resampled clusterings."
    )


def export(results: Mapping[str, DataFrame], texts: Mapping[str, DataFrame], folder: str) -> None:
    """Every table as Parquet and CSV, every text (a ``line`` column) as text, each in a folder of its name."""
    for name, df in results.items():
        tables.write_table(df, f"{folder}/{name}/parquet")
        tables.write_csv(df, f"{folder}/{name}/csv")
    for name, df in texts.items():
        tables.write_text(df, "line", f"{folder}/{name}/text")
