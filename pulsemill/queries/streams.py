"""A stream over the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.columns import micros
from ..sources.staging import shared_folder
from ..streaming import windows
from .base import query, read


def scratch(spark) -> str:
    """A new folder in the one that all executors share."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@query(
    "SELECT CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) * 86400000000 AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1, 2"
)
def stream_window_stats(spark, sf_dir):
    """Statistics of each day and channel, from a stream."""
    schema = read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    stream = stream.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    out = windows.run_once(windows.window_stats(stream, "ts", ["event_type"], "value", "1 day", "1 day"), scratch(spark))
    return out.select(micros("start").alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"), "low", "high", F.round("std", 6).alias("std"))
