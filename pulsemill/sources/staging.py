"""Tables between the rounds of an iterative operator, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset a temporary one, in local mode alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame, name: str = "round") -> DataFrame:
    """The frame written as Parquet and read again: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_all(frames: Sequence[DataFrame], name: str = "round", at_once: int = 8) -> list[DataFrame]:
    """Frames that don't need each other, each stored as by ``staged``; up to ``at_once`` of their jobs run side by side."""
    with ThreadPoolExecutor(at_once) as pool:
        tasks = [pool.submit(inheritable_thread_target(frame.sparkSession)(staged), frame, name) for frame in frames]
        return [task.result() for task in tasks]


def release(spark: SparkSession) -> None:
    """Deletes all that ``staged`` has written in this application; for when results are written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)
