"""From samples to a profiled grouping of encounters (inventory 3.2 to 3.4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.registry import STATISTICS, kept_features
from ..operators import cleaning, linkage, modelling, profiles, stats, windows


def segment_features(samples: DataFrame, onset: DataFrame, width: int, segments: int, channels: Sequence[str], statistics: Sequence[str] = STATISTICS) -> DataFrame:
    """The wide feature row of every backward segment, with its status."""
    cut = windows.backward_segments(samples, onset, "fin", "t", "onset", width, segments)
    long_ = stats.series_stats(cut, ["fin", "segment", "channel"], ["t"], statistics=statistics)
    wide = stats.wide_stats(long_, ["fin", "segment"], "channel", channels, statistics)
    counts = [F.coalesce(F.col(f"{c}_valid_n"), F.lit(0)) for c in channels] if "valid_n" in statistics else [F.lit(1)]
    some = counts[0]
    for c in counts[1:]:
        some = some + c
    return wide.withColumn("status", F.when(some > 0, "perfect").otherwise("no_signals"))


def audit(features: DataFrame) -> DataFrame:
    """Segments and encounters by status."""
    return features.groupBy("status").agg(F.count("*").alias("segments"), F.count_distinct("fin").alias("encounters"))


def clean_features(features: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Outliers and sparse columns and rows go; gaps are filled inside an encounter, then by the median."""
    from ..operators.signals import iqr_to_null

    perfect = cleaning.to_null(features.where("status = 'perfect'"), columns)
    dense, kept = cleaning.drop_sparse(iqr_to_null(perfect, columns), columns)
    filled = windows.fill_both_ways(dense, ["fin"], ["segment"], kept)
    return cleaning.median_impute(filled, kept), kept


def phenotypes(features: DataFrame, columns: Sequence[str], k: int, reducer: str = "pca", resamples: int = 10, seed: int = 42, method: str = "kmeans") -> tuple[DataFrame, list[str]]:
    """Cluster of each encounter by its last segment: feature selection, reduction and consensus clustering (by ``kmeans`` or average ``linkage``)."""
    first = features.where("segment = 0").select("fin", *kept_features(columns))
    selected, names = cleaning.select_features(first, [c for c in first.columns if c != "fin"])
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(selected)
    reduced = modelling.REDUCERS[reducer](vectors, "fin")
    if method == "linkage":
        labels = linkage.consensus_clusters(*linkage.consensus(reduced, "fin", ks=(k,), resamples=resamples, seed=seed), k, twice=True).withColumnRenamed("row", "fin")
    else:
        labels = modelling.consensus_labels(reduced, "fin", k=k, resamples=resamples, seed=seed)
    return selected.join(labels.select("fin", "cluster"), "fin"), names


def report(assigned: DataFrame, names: Sequence[str], k: int = 10) -> DataFrame:
    """The comparison table of the clusters, their features ranked by standardised distance from the cohort."""
    long_ = assigned.unpivot(["fin", "cluster"], list(names), "feature", "value")
    profile = profiles.group_profile(long_, "cluster").withColumn("importance", F.abs(F.col("mean") - F.col("overall")))
    top = profiles.top_features(profile, "cluster", k)
    groups = assigned.groupBy("cluster").agg(F.count("*").alias("n")).withColumn("name", F.concat(F.lit("Phenotype_"), F.col("cluster")))
    return profiles.comparison(groups, "cluster", "name", top)
