"""Registration of queries, and the tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import micros

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name, with its SQL if SQL can express it."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql.strip()
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as samples (fin, channel, t, value) with t in microseconds."""
    e = read(spark, sf_dir, "events", "user_id", "event_type", "ts", "value", "event_id")
    return e.select(e.user_id.alias("fin"), e.event_type.alias("channel"), micros("ts").alias("t"), "value", e.event_id.alias("sample_id"))


#: The same rows in SQL.
SAMPLES = "samples AS (SELECT user_id AS fin, event_type AS channel, epoch_us(ts) AS t, value, event_id AS sample_id FROM events)"
