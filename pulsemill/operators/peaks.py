"""Peaks by height, greedy distance and width at half their prominence (inventory K9, K10).

A key is one bounded segment of a series; its samples are one task's arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def maxima(x: np.ndarray) -> np.ndarray:
    """Places higher than what is to both sides; of a flat top the middle, rounded down. The ends are none."""
    if len(x) < 3:
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.diff(x, prepend=np.nan) != 0)
    last = np.append(first[1:], len(x)) - 1
    level = x[first]
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    return (first[top] + last[top]) // 2


def apart(at: np.ndarray, height: np.ndarray, distance: float) -> np.ndarray:
    """Which peaks stay when the highest (of equals the last) takes all nearer than ``distance`` with it, and so on.

    In a round every peak that is the highest of those open around it stays, and
    those around it go; this leaves what going from peak to peak leaves.
    """
    n = len(at)
    order = np.empty(n, np.int64)
    order[np.lexsort((at, height))] = np.arange(n)
    low, high = np.searchsorted(at, at - distance, "right"), np.searchsorted(at, at + distance, "left")
    stays, is_open = np.zeros(n, bool), np.ones(n, bool)
    while is_open.any():
        rank = np.where(is_open, order, -1)
        for i in np.flatnonzero(is_open):
            stays[i] = rank[low[i] : high[i]].max() == order[i]
        for i in np.flatnonzero(stays & is_open):
            is_open[low[i] : high[i]] = False
    return stays


def half_widths(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prominence of each peak over the higher of its two bases, and its width at half of that, with linear steps between samples."""
    prominence, width = np.zeros(len(at)), np.zeros(len(at))
    for k, p in enumerate(at):
        left, right = np.flatnonzero(x[:p] > x[p]), np.flatnonzero(x[p + 1 :] > x[p])
        a, b = (left[-1] + 1 if len(left) else 0), (p + 1 + right[0] if len(right) else len(x))
        base = max(x[a : p + 1].min(), x[p:b].min())
        prominence[k] = x[p] - base
        level = x[p] - prominence[k] / 2
        # the first sample to each side that is no higher than the level
        under = np.flatnonzero(x[a:p] <= level)
        i = a + under[-1] if len(under) else a
        begin = i + (level - x[i]) / (x[i + 1] - x[i]) if x[i] < level else float(i)
        over = np.flatnonzero(x[p + 1 : b] <= level)
        j = p + 1 + over[0] if len(over) else b - 1
        end = j - (level - x[j]) / (x[j - 1] - x[j]) if x[j] < level else float(j)
        width[k] = end - begin
    return prominence, width


def peaks(x: np.ndarray, distance: float = 1, height: float | None = None, least_width: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, prominences, widths) of the peaks of at least ``height``, then by distance, then of at least ``least_width``."""
    at = maxima(x)
    if height is not None:
        at = at[x[at] >= height]
    at = at[apart(at, x[at], distance)]
    prominence, width = half_widths(x, at)
    wide = width >= least_width
    return at[wide], prominence[wide], width[wide]


def greedy_peaks(rows: DataFrame, keys: Sequence[str], distance: float, height: float | None = None, least_width: float = 0.0, inner: bool = False) -> DataFrame:
    """Rows (keys, i, v, prominence, width) of the peaks of each key's samples (i, v), widths in samples; with ``inner`` without each key's first and last.

    Samples without a value are left out, and those next to them are neighbours.
    """
    schema = "".join(f"{k} {rows.schema[k].dataType.simpleString()}, " for k in keys) + "i long, v double, prominence double, width double"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        i, v = table["i"].to_numpy(), table["v"].to_numpy()
        at, prominence, width = peaks(v, distance, height, least_width)
        some = slice(1, -1) if inner else slice(None)
        at, prominence, width = at[some], prominence[some], width[some]
        same = {k: pa.array([table[k][0].as_py()] * len(at), table.schema.field(k).type) for k in keys}
        return pa.table({**same, "i": pa.array(i[at], pa.int64()), "v": v[at], "prominence": prominence, "width": width})

    return rows.where(F.col("v").isNotNull()).select(*keys, F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("v")).groupBy(*keys).applyInArrow(run, schema)
