"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_written: list[str] = []
_tables: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a temporary folder is set and used, in local mode alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder.rstrip("/")


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """The frame written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``stored``, and the path for ``drop``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Deletes one stored table that nothing reads any more."""
    _written.remove(path)
    gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)


def stored_in_buckets(df: DataFrame, name: str, buckets: int, column: str) -> DataFrame:
    """The frame as a table in the warehouse, in buckets, so that a group by ``column`` doesn't move it."""
    spark = df.sparkSession
    full = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, column).option("compression", "uncompressed").saveAsTable(full)
    _tables.append(full)
    return spark.table(full)


def release(spark: SparkSession) -> None:
    """Deletes all that the operators have stored in this application; for when their results are written."""
    while _written:
        drop(spark, _written[-1])
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
