"""Spectral clustering of what several labellings agree on (inventory M27), without a matrix of rows.

The co-association of two rows is the share of labellings in which they have one
label: W = H H' / B, with H the rows' labels as indicators (a column, or cell, for
each label of each labelling).  With D the rows' degrees, the leading eigenvectors
of D^-1/2 W D^-1/2 come from the small matrix G = H' D^-1 H / B between cells, by
u = D^-1/2 H q / sqrt(B s), for q an eigenvector of G and s its eigenvalue.  G is a
sum over rows, added up in Spark; so the work is linear in the rows, and exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged

#: Labels of all labellings together; the driver holds a square of them.
MOST_CELLS = 4096


def vote_groups(labels: DataFrame, votes: str = "votes") -> DataFrame:
    """Rows (votes, n): the distinct rows of labels and how many rows have them."""
    return labels.groupBy(F.col(votes).cast("array<int>").alias("votes")).agg(F.count("*").alias("n"))


def cells_of(groups: DataFrame) -> DataFrame:
    """Rows (votes, n, b, label): a row for each label that a group has."""
    return groups.select("votes", "n", F.posexplode("votes").alias("b", "label")).where("label is not null")


def embedding(groups: DataFrame, size: int) -> tuple[DataFrame, list[float]]:
    """Adds to the groups ``u``: their entries of the ``size`` leading eigenvectors of the random walk on the co-association, and the eigenvalues.

    Rows without any label have no degree, and get zeros.
    """
    long_ = cells_of(groups)
    cells = long_.groupBy("b", "label").agg(F.sum("n").alias("size")).limit(MOST_CELLS + 1).collect()  # a row for each label of each labelling
    if len(cells) > MOST_CELLS:
        raise ValueError(f"the labellings have more than {MOST_CELLS} labels together")
    cells.sort(key=lambda r: (r.b, r.label))
    spark = groups.sparkSession
    sizes = spark.createDataFrame([(r.b, r.label, i, r.size) for i, r in enumerate(cells)], "b int, label int, cell int, size long")
    # B cancels: W and D are both taken B times
    held = long_.join(F.broadcast(sizes), ["b", "label"]).groupBy("votes", "n").agg(F.sort_array(F.collect_list("cell")).alias("cells"), F.sum("size").alias("degree"))
    held = staged(held, "cells")
    pairs = held.select((F.col("n") / F.col("degree")).alias("w"), F.explode("cells").alias("a"), "cells").select("w", "a", F.explode("cells").alias("c"))
    gram = np.zeros((len(cells), len(cells)))
    for r in pairs.groupBy("a", "c").agg(F.sum("w").alias("w")).toLocalIterator():
        gram[r.a, r.c] = r.w
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    order = np.argsort(-value)[: min(size, len(cells))]
    value, vector = value[order], vector[:, order]
    vector = vector * np.where(vector.sum(0) < 0, -1, 1) / np.sqrt(np.maximum(value, 1e-12))  # one sign for each
    vector[:, value < 1e-9] = 0
    table = spark.createDataFrame([(i, q) for i, q in enumerate(vector.tolist())], "cell int, q array<double>")
    each = held.select("votes", "degree", F.explode("cells").alias("cell")).join(F.broadcast(table), "cell")
    found = each.groupBy("votes").agg(F.array(*[F.sum(F.col("q")[i] / F.col("degree")) for i in range(len(order))]).alias("u"))
    zeros = F.array(*[F.lit(0.0)] * len(order))
    return groups.join(found, "votes", "left").select("votes", "n", F.coalesce("u", zeros).alias("u")), value.tolist()


def spectral_clusters(labels: DataFrame, row_id: str, k: int, votes: str = "votes", seed: int = 42) -> DataFrame:
    """Rows (row_id, cluster): k-means of the spectral embedding; rows with equal labels are in one cluster."""
    groups = staged(vote_groups(labels, votes), "groups")
    placed = staged(embedding(groups, k)[0], "spectral")
    at = placed.withColumn("features", array_to_vector("u"))
    best = None
    for s in range(seed, seed + 5):  # the best of several starts
        model = KMeans(k=k, seed=s, maxIter=100, weightCol="n", predictionCol="cluster").fit(at)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    named = best.transform(at).select("votes", "cluster")
    return labels.select(row_id, F.col(votes).cast("array<int>").alias("votes")).join(named, "votes").select(row_id, "cluster")
