"""Ranges of waveform channels as a Spark data source (inventory SC7, SC8): NPY arrays and WFDB records of one or more data files.

    register(spark)
    spark.read.format("wave_ranges").option("path", folder).option("start", 60).option("stop", 360).load()

A row is a piece of a channel, and a partition reads one piece: it opens the file,
goes to the piece's first byte and reads no further than its last.  Filters on
record, channel and t decide which pieces there are before any is read; Spark wants
spark.sql.python.filterPushdown.enabled set for that.  Files are opened through
pyarrow's file systems, by the scheme of the path.

A file that can't be read gives one row with a status, no channel and no samples.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions.registry import status_of
from .waves import wfdb_samples

SCHEMA = "record string, channel string, fs double, first long, t double, samples array<double>, bytes long, status string"
#: Fixed values of the format: values in a group of bytes, and the bytes of that group.
PACKED = {"16": (1, 2), "212": (2, 3), "80": (1, 1)}


@dataclass
class Channel:
    """Where a channel's values are, and what they mean: every ``step``-th value from ``at`` on, physical after (value - base) / gain."""

    record: str
    name: str | None
    fs: float
    path: str
    kind: str
    begin: int = 0
    at: int = 0
    step: int = 1
    length: int = 0
    gain: float = 1.0
    base: float = 0.0
    status: str = "perfect"

    def read(self, files: pafs.FileSystem, first: int, last: int) -> tuple[np.ndarray, int]:
        """Values first up to last, and how many bytes that took."""
        values, size = PACKED.get(self.kind, (1, np.dtype(self.kind).itemsize if self.kind not in PACKED else 0))
        low, high = first * self.step, last * self.step
        group = low // values
        with files.open_input_file(self.path) as source:
            source.seek(self.begin + group * size)
            data = source.read((-(-high // values) - group) * size)
        if self.kind in PACKED:
            raw = np.frombuffer(data, np.uint8).astype(np.int32) - 128 if self.kind == "80" else wfdb_samples(self.kind, data)
        else:
            raw = np.frombuffer(data, self.kind)
        own = raw[low - group * values :][: high - low][self.at :: self.step].astype(float)
        return (own - self.base) / self.gain, len(data)


def npy_channel(files: pafs.FileSystem, path: str, fs: float) -> Channel:
    stem = path.rsplit("/", 1)[-1].removesuffix(".npy")
    with files.open_input_file(path) as source:
        version = np.lib.format.read_magic(source)
        shape, by_columns, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(source)
        if kind.hasobject or (by_columns and len(shape) > 1):
            raise ValueError("not a plain array")
        return Channel(stem, stem, fs, path, kind.str, source.tell(), length=int(np.prod(shape)))


def wfdb_channels(files: pafs.FileSystem, path: str) -> list[Channel]:
    """Channels of a header; signals of one data file are interleaved and share its format, files may differ."""
    folder, _, name = path.rpartition("/")
    record = name.removesuffix(".hea")
    with files.open_input_stream(path) as source:
        lines = [x for x in source.read().decode("latin-1").splitlines() if x.strip() and not x.startswith("#")]
    head = lines[0].split()
    n, fs = int(head[1]), float(head[2].split("/")[0].split("(")[0]) if len(head) > 2 else 250.0
    found: dict[str, list[Channel]] = {}
    for i, line in enumerate(lines[1 : n + 1]):
        part = line.split()
        kind, _, begin = part[1].partition("+")
        if kind not in PACKED:
            raise ValueError(f"format {kind} can't be read")
        gain = part[2].split("/")[0] if len(part) > 2 else "200"
        base = gain.split("(")[1].rstrip(")") if "(" in gain else part[4] if len(part) > 4 else "0"
        label = " ".join(part[8:]).rstrip(",") if len(part) > 8 else f"ch{i}"
        own = found.setdefault(part[0], [])
        own.append(Channel(record, label, fs, f"{folder}/{part[0]}", kind, int(begin or 0), len(own), gain=float(gain.split("(")[0]) or 200.0, base=float(base)))
    for own in found.values():
        if len({c.kind for c in own}) > 1:
            raise ValueError("signals of one file in several formats")
        size = files.get_file_info(own[0].path)
        if size.type == pafs.FileType.NotFound:
            raise FileNotFoundError(own[0].path)
        values, group = PACKED[own[0].kind]
        for c in own:
            c.step = len(own)
            c.length = (size.size - c.begin) // group * values // len(own)
    return [c for own in found.values() for c in own]


class Piece(InputPartition):
    def __init__(self, channel: Channel, first: int, last: int):
        self.channel, self.first, self.last = channel, first, last


class RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.chunk = int(options.get("chunk", 300_000))
        self.fs = float(options.get("fs", 1))
        self.start, self.stop = float(options.get("start", 0)), float(options.get("stop", "inf"))
        self.rules: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes those on record, channel and t; gives the others back."""
        for f in filters:
            names = ("record", "channel") if isinstance(f, EqualTo | In) else ("t",) if isinstance(f, GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) else ()
            if len(f.attribute) == 1 and f.attribute[0] in names:
                self.rules.append(f)
            else:
                yield f

    def wanted(self, channel: Channel, t: float) -> bool:
        for f in self.rules:
            x = {"record": channel.record, "channel": channel.name, "t": t}[f.attribute[0]]
            if isinstance(f, EqualTo | In):
                good = x is not None and x in (f.value if isinstance(f, In) else (f.value,))
            else:
                good = {GreaterThan: t > f.value, GreaterThanOrEqual: t >= f.value, LessThan: t < f.value, LessThanOrEqual: t <= f.value}[type(f)]
            if not good:
                return False
        return True

    def channels(self, files: pafs.FileSystem, path: str) -> list[Channel]:
        try:
            return wfdb_channels(files, path) if path.endswith(".hea") else [npy_channel(files, path, self.fs)]
        except Exception as error:  # noqa: BLE001  the class becomes the row's status
            stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
            return [Channel(stem, None, self.fs, path, "", status=status_of(error))]

    def partitions(self) -> Sequence[InputPartition]:
        files, base = pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)
        info = files.get_file_info(base)
        listed = [info] if info.type == pafs.FileType.File else files.get_file_info(pafs.FileSelector(base, recursive=True))
        paths = sorted(x.path for x in listed if x.type == pafs.FileType.File and x.path.endswith((".npy", ".hea")))
        out = []
        with ThreadPoolExecutor(16) as pool:  # headers alone
            for own in pool.map(lambda p: self.channels(files, p), paths):
                for c in own:
                    first, last = int(np.ceil(self.start * c.fs)), int(min(c.length, np.ceil(min(self.stop, c.length / c.fs) * c.fs)))
                    begins = range(first, last, self.chunk) if c.name is not None else (0,)
                    out += [Piece(c, a, min(a + self.chunk, last)) for a in begins if self.wanted(c, a / c.fs)]
        return out

    def read(self, piece: Piece | None) -> Iterator[pa.RecordBatch]:
        if piece is None:  # there are no pieces at all
            return
        c = piece.channel
        status, samples, size = c.status, np.zeros(0), 0
        if c.name is not None:
            try:
                files = pafs.FileSystem.from_uri(self.path)[0] if "://" in self.path else pafs.LocalFileSystem()
                samples, size = c.read(files, piece.first, piece.last)
            except Exception as error:  # noqa: BLE001  the class becomes the row's status
                status = status_of(error)
        row = {"record": c.record, "channel": c.name, "fs": c.fs, "first": piece.first, "t": piece.first / c.fs, "samples": samples.tolist(), "bytes": size, "status": status}
        kinds = (pa.string(), pa.string(), pa.float64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], list(row))


class WaveRanges(DataSource):
    """Options: ``path`` (a file or folder), ``start`` and ``stop`` in seconds, ``chunk`` in samples, ``fs`` of NPY arrays."""

    @classmethod
    def name(cls) -> str:
        return "wave_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RangeReader:
        return RangeReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WaveRanges)
