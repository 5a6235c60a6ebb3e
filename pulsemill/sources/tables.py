"""Table scans and sinks (inventory 2.1 SC1-SC4, SC10-SC12; 2.2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import clean_double
from ..operators.relational import drop_positional


def read_csv(spark: SparkSession, path: str, schema: str | None = None, skip_bad_lines: bool = False) -> DataFrame:
    """A CSV table with header; bad lines fail, or are skipped; left-over index columns go."""
    reader = spark.read.option("header", True).option("mode", "DROPMALFORMED" if skip_bad_lines else "FAILFAST")
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return drop_positional(df)


def ingest(df: DataFrame) -> DataFrame:
    """NaN and infinities of all float columns become null, once, at the door."""
    return df.withColumns({c: clean_double(c) for c, t in df.dtypes if t in ("double", "float")})


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Rows (path, name, modified, size) of the files in a folder; their content isn't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON documents of one or several lines."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """A stage's result as Parquet."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """For other programs: CSV with header, one file per task."""
    df.write.mode(mode).option("header", True).csv(path)


def write_text(df: DataFrame, column: str, path: str, mode: str = "overwrite") -> None:
    """Reports, cards or JSON lines: one text column."""
    df.select(F.col(column).cast("string").alias("value")).write.mode(mode).text(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)
