"""Operator 1: packing into optimal length buckets.

The lengths of all documents are counted into one histogram of at most
``max_len`` bins; dynamic programming over it chooses the ``buckets`` upper
bounds with the least total padding.  Inside each bucket, sequences form
batches of at most ``budget`` tokens (padding included).

A document's length is its words plus one end token.  A longer document than
``max_len`` is cut into pieces of that length, so nothing is lost.

Edge cases: null, empty and blank texts have length 1.  Repeated rows are packed
one by one.  Ties in the dynamic programme take the smaller bound; an empty
table gives an empty result; extra columns are ignored by ``pack``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import gapless
from .storage import stored
from .textkit import table

WORD = r"[^\x20\x09-\x0D]+"


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets with the least padding."""
    order = np.argsort(lengths)
    size, count = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    n = len(size)
    rows = np.concatenate([[0], np.cumsum(count)])
    if not n:
        return []
    # padding of (i, j] = size[j-1] * (rows[j] - rows[i]) - const(j) + const(i)
    tokens = np.concatenate([[0], np.cumsum(count * size)])
    best = np.full(n + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    back = []
    for _ in range(min(buckets, n)):
        new, choice = best.copy(), np.full(n + 1, -1)
        for j in range(1, n + 1):
            cost = best[:j] + size[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            i = int(cost.argmin())
            if cost[i] < new[j]:
                new[j], choice[j] = cost[i], i
        back.append(choice)
        best = new
    bounds, j = [], n
    for choice in reversed(back):
        if j and choice[j] >= 0:
            bounds.append(int(size[j - 1]))
            j = choice[j]
    return sorted(bounds)


def pack(docs: DataFrame, text: str = "text", id_col: str = "doc_id", max_len: int = 2048, buckets: int = 12, budget: int = 65_536) -> DataFrame:
    """One row per sequence: id, piece, n_tokens, bucket, padded_len, batch_id, batch_slot."""
    length = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)) + 1
    pieces = (
        docs.select(F.col(id_col), length.alias("__length"))
        .select(id_col, "__length", F.explode(F.sequence(F.lit(0), F.floor((F.col("__length") - 1) / max_len).cast("int"))).alias("piece"))
        .select(id_col, "piece", F.least(F.lit(max_len), F.col("__length") - F.col("piece") * max_len).cast("int").alias("n_tokens"))
    )
    pieces = stored(pieces, "pieces")
    hist = pieces.groupBy("n_tokens").agg(F.count("*").alias("n")).toPandas()
    bounds = best_bounds(hist.n_tokens.to_numpy(), hist.n.to_numpy(), buckets)
    bucket = F.lit(len(bounds) - 1)
    for i in range(len(bounds) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= bounds[i], i).otherwise(bucket)
    padded = F.element_at(F.array(*[F.lit(int(b)) for b in bounds or [1]]), F.col("bucket") + 1)
    dealt = pieces.withColumn("bucket", bucket.cast("int"))
    numbered = gapless(dealt, "bucket", [F.col(id_col), F.col("piece")], int(hist.n.sum()), "__at")
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("padded_len")).cast("long"))
    return numbered.withColumn("padded_len", padded).select(
        id_col, "piece", "n_tokens", "bucket", "padded_len", F.floor(F.col("__at") / room).cast("long").alias("batch_id"), (F.col("__at") % room).cast("int").alias("batch_slot")
    )


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
