"""Waveform scans through Spark's binary reader, so that any store Spark can read will do (inventory SC5-SC9)."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.registry import status_of


def read_npy(spark: SparkSession, path: str, chunk: int = 300_000, first: int = 0, last: int | None = None) -> DataFrame:
    """Rows (path, channel, first, samples, status): the samples from ``first`` up to, without, ``last`` of each ``name.npy`` array, in chunks.

    An unreadable file gives one row with a status.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                channel = name.rsplit("/", 1)[-1].removesuffix(".npy")
                try:
                    x = np.load(io.BytesIO(content), allow_pickle=False).ravel()[:last]
                    parts, status = [(i, x[i : i + chunk].astype(float).tolist()) for i in range(first, len(x), chunk)] or [(first, [])], "perfect"
                except Exception as error:  # noqa: BLE001  the class becomes the row's status
                    parts, status = [(0, [])], status_of(error)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(parts)), pa.array([channel] * len(parts)), pa.array([p[0] for p in parts], pa.int64()), pa.array([p[1] for p in parts], pa.list_(pa.float64())), pa.array([status] * len(parts))],
                    ["path", "channel", "first", "samples", "status"],
                )

    return files.mapInArrow(run, "path string, channel string, first long, samples array<double>, status string")


def wfdb_samples(kind: str, data: bytes) -> np.ndarray:
    """The raw values of one data file in format 16 or 212."""
    if kind == "16":
        return np.frombuffer(data[: len(data) // 2 * 2], "<i2")
    if kind == "212":
        b = np.frombuffer(data[: len(data) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        raw = np.stack([b[:, 0] | (b[:, 1] & 0x0F) << 8, b[:, 2] | (b[:, 1] >> 4) << 8], 1).reshape(-1)
        return np.where(raw > 2047, raw - 4096, raw)
    raise ValueError(f"format {kind} can't be read")


def decode_wfdb(header: str, data: bytes) -> dict[str, tuple[float, np.ndarray]]:
    """Channels of a record in format 16 or 212: name to (sampling rate, physical values).

    Signals of one data file share its format; a header that gives them several is
    an error (ValueError).
    """
    lines = [x for x in header.splitlines() if x and not x.startswith("#")]
    first = lines[0].split()
    n, fs = int(first[1]), float(first[2].split("/")[0].split("(")[0])
    specs = []
    for line in lines[1 : n + 1]:
        p = line.split()
        gain = p[2].split("/")[0]
        base = int(gain.split("(")[1].rstrip(")")) if "(" in gain else int(p[4]) if len(p) > 4 else 0
        specs.append((p[1].split("x")[0].split(":")[0].split("+")[0], float(gain.split("(")[0]) or 200.0, base, " ".join(p[8:]) if len(p) > 8 else f"ch{len(specs)}"))
    if len({s[0] for s in specs}) != 1:
        raise ValueError("signals of one file in several formats")
    raw = wfdb_samples(specs[0][0], data)
    raw = raw[: len(raw) // n * n].reshape(-1, n)
    return {name.rstrip(","): (fs, (raw[:, i] - base) / gain) for i, (_, gain, base, name) in enumerate(specs)}


def read_wfdb(spark: SparkSession, path: str) -> DataFrame:
    """Rows (record, channel, fs, samples, status) of the records in a folder: headers with their data files.

    A record without a data file or that can't be read gives one row with a status.
    """
    files = spark.read.format("binaryFile").load(path)
    stem = F.regexp_extract("path", r"([^/]+)\.(?:hea|dat)$", 1)
    of = lambda kind: files.where(F.col("path").endswith(f".{kind}")).select(stem.alias("record"), F.col("content").alias(kind))
    joined = of("hea").join(of("dat"), "record", "left")

    def run(batches):
        for batch in batches:
            for record, hea, dat in zip(*(batch.column(c).to_pylist() for c in ("record", "hea", "dat")), strict=True):
                try:
                    if dat is None:
                        raise FileNotFoundError(record)
                    found = [(name, fs, x.tolist(), "perfect") for name, (fs, x) in decode_wfdb(hea.decode("latin-1"), dat).items()]
                except Exception as error:  # noqa: BLE001  the class becomes the row's status
                    found = [(None, None, None, status_of(error))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([record] * len(found)), pa.array([v[0] for v in found], pa.string()), pa.array([v[1] for v in found], pa.float64()), pa.array([v[2] for v in found], pa.list_(pa.float64())), pa.array([v[3] for v in found])],
                    ["record", "channel", "fs", "samples", "status"],
                )

    return joined.mapInArrow(run, "record string, channel string, fs double, samples array<double>, status string")


def first_minutes(df: DataFrame, samples: str, fs: str, minutes: float) -> DataFrame:
    """Only the first minutes of each series."""
    return df.withColumn(samples, F.slice(F.col(samples), F.lit(1), (F.lit(minutes * 60) * F.col(fs)).cast("int")))


def attribute_time(meta: str):
    """The time of a JSON attribute without the last four characters of its text."""
    text = F.get_json_object(meta, "$.time_origin")
    return F.to_timestamp_ntz(F.substring(text, F.lit(1), F.length(text) - 4))
