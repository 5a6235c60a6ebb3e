"""From raw channels of a segment to clean ones at one rate: flat stretches, outliers, resampling, median and band filters (inventory K2, K3, W18)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import dealt
from . import kernels

#: High-pass and low-pass in Hz and the order of each channel's filters, which must match.
FILTERS = {"II": (0.8, 60.0, 4), "Pleth": (0.5, 8.0, 2), "Resp": (0.1, 0.5, 2), "ABP": (None, 15.0, 4)}
#: Deviations that make an outlier before and after filtering, the share of flat samples from which a channel is no signal, and the median's width in seconds.
BEFORE, AFTER, FLAT, MEDIAN_S = 6.0, 5.0, 0.8, 0.015

#: Values of a batch that a task gives back, about.
BATCH = 1 << 20


def flat_samples(x: np.ndarray, least: int) -> np.ndarray:
    """Which samples are in a stretch of ``least`` or more equal ones."""
    if not len(x):
        return np.zeros(0, bool)
    first = np.flatnonzero(np.diff(x, prepend=np.nan) != 0)
    size = np.diff(np.append(first, len(x)))
    return np.repeat(size >= least, size)


def within(x: np.ndarray, deviations: float) -> np.ndarray:
    """Values farther from the mean than so many deviations become the median of all."""
    far = np.abs(x - x.mean()) > deviations * x.std()
    return np.where(far, np.median(x), x)


def running_median(x: np.ndarray, width: int) -> np.ndarray:
    """The median of ``width`` samples (odd) around each one, zeros beyond the ends."""
    if width < 3:
        return x
    padded = np.concatenate([np.zeros(width // 2), x, np.zeros(width // 2)])
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, width), 1)


def conditioned(x: np.ndarray, fs: float, target: float, high: float | None, low: float | None, order: int) -> np.ndarray:
    """One channel at the target rate; none at all where it is mostly flat."""
    flat = flat_samples(x, int(np.ceil(fs)))
    if len(x) < 2 or flat.mean() >= FLAT:
        return np.zeros(0)
    x = within(np.where(flat, np.median(x), x), BEFORE)
    x = kernels.resample(x, fs, target) if fs != target else x
    width = int(MEDIAN_S * target)
    x = running_median(x, width - 1 + width % 2)
    low = min(low, 0.45 * target) if low else low
    return within(kernels.band_pass(x, target, high, low, order), AFTER)


def condition(samples: DataFrame, keys: Sequence[str], order: Sequence[str], rates: Mapping[str, float], target: float, channels: Mapping[str, str], channel: str = "channel", value: str = "value") -> DataFrame:
    """Rows (keys, channel, i, value) of each segment's channels at the rate ``target``; one task for each channel of a bounded segment.

    ``rates`` has the rate of II, Pleth, Resp and ABP, ``channels`` their names in the
    table.  Missing samples are left out; other channels, and mostly flat ones, give no rows.
    """
    names = {name: kind for kind, name in channels.items()}
    fields = "".join(f"{k} {samples.schema[k].dataType.simpleString()}, " for k in keys)

    same = [*keys, "channel"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, done, size, begin = batch.column("values"), [], 0, 0
            for j, kind in enumerate(batch.column("channel").to_pylist()):
                kind = names[kind]
                done.append(conditioned(lists[j].values.to_numpy(zero_copy_only=False), rates[kind], target, *FILTERS[kind]))
                size += len(done[-1])
                if size >= BATCH or j + 1 == batch.num_rows:
                    ends = pa.array(np.cumsum([0, *map(len, done)]), pa.int32())
                    out = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(done), pa.float64()))
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(begin, len(done)) for c in same], out], [*same, "values"])
                    done, size, begin = [], 0, j + 1

    at = [c for o in order for c in (F.col(o).isNull(), F.col(o))]  # nulls last
    held = samples.where(F.col(channel).isin(list(names)) & F.col(value).isNotNull())
    held = held.select(*keys, F.col(channel).alias("channel"), F.struct(*[c.alias(f"o{j}") for j, c in enumerate(at)], F.col(value).cast("double").alias("value")).alias("x"))
    lists = dealt(held, *same).groupBy(*same).agg(F.sort_array(F.collect_list("x")).alias("x")).select(*same, F.col("x.value").alias("values"))
    found = lists.mapInArrow(run, f"{fields}channel string, values array<double>")
    return found.select(*same, F.posexplode("values").alias("i", "value")).withColumn("i", F.col("i").cast("long"))
