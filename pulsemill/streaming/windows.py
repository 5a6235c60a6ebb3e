"""Windowed statistics and the sticky channel drop on streams (inventory 2.18, an extension)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def window_stats(stream: DataFrame, t: str, keys: Sequence[str], value: str, width: str, late: str) -> DataFrame:
    """Count, sum, extremes and deviation of each key in each tumbling window; events later than ``late`` don't count."""
    return (
        stream.withWatermark(t, late)
        .groupBy(F.window(t, width).alias("__w"), *keys)
        .agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"), F.stddev_pop(value).alias("std"))
        .select(F.col("__w.start").alias("start"), *keys, "n", "total", "low", "high", "std")
    )


def sticky_state(least: int) -> Callable:
    """Once a key has a segment below ``least`` samples, all its later segments are invalid."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        good = state.get[0] if state.exists else True
        for frame in frames:
            frame = frame.sort_values("segment")
            valid = []
            for n in frame["n"]:
                good = good and n >= least
                valid.append(good)
            yield pd.DataFrame({"fin": key[0], "segment": frame["segment"], "n": frame["n"], "valid": valid})
        state.update((bool(good),))

    return run


def sticky_drop(stream: DataFrame, least: int) -> DataFrame:
    """Rows (fin, segment, n, valid) of a stream of segment counts that come in order for each fin."""
    return stream.groupBy("fin").applyInPandasWithState(sticky_state(least), "fin long, segment long, n long, valid boolean", "good boolean", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all there is; each batch's result goes to a table in ``folder``, which is read again.

    In complete mode the last result stands; in append mode all of them.
    """
    spark = stream.sparkSession
    out = f"{folder}/result"

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    df = spark.read.parquet(out)
    return df if mode == "complete" else df.drop("batch")
