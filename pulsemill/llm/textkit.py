"""Vectorised text primitives shared by the operators of this subpackage.

Texts reach Python as UTF-8 bytes in Arrow batches.  They are cut into chunks
of about ``CHUNK`` bytes, joined with a space and handled as one byte array, so
memory stays bounded by the chunk (or by one document, where that is longer).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 20
U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
STEP = U64(0xD6E8FEB86659FD93)

_powers: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i below n (BASE is odd)."""
    if len(_powers["up"]) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        for name, factor in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            table = np.full(size, factor, U64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (splitmix finaliser)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash of a byte array; one longer than it."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end); equal bytes give equal hashes anywhere."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Chunk:
    """The words of several texts: ``start``/``end`` in ``data``, hash and document of each word."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        self.n_docs = len(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.doc_end = np.cumsum(sizes) - 1
        self.doc_start = self.doc_end - (sizes - 1)
        self.data = LOWER[self.raw] if lower else self.raw
        gap = SPACE[self.raw]
        inside = np.zeros(len(gap) + 1, np.int8)
        np.logical_not(gap, out=inside[1:].view(bool))
        edge = np.diff(inside)
        self.gap = gap
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.prefix = prefix_hash(self.data)
        self.hash = span_hash(self.prefix, self.start, self.end)
        self.first = np.searchsorted(self.start, self.doc_start)
        self.count = np.diff(np.append(self.first, len(self.start)))
        self.doc = np.repeat(np.arange(self.n_docs), self.count)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value per word, by document."""
        total = np.concatenate([[0], np.cumsum(values)])
        return total[self.first + self.count] - total[self.first]

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-word windows inside documents, and the index of each one's first word."""
        if len(self.hash) < n:
            return np.empty(0, U64), np.empty(0, np.int64)
        size = len(self.hash) - n + 1
        acc = np.zeros(size, U64)
        for i in range(n):
            acc *= STEP
            acc += self.hash[i : i + size]
        at = np.flatnonzero(self.doc[:size] == self.doc[n - 1 :])
        return mix(acc[at]), at


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with the bytes of ``column`` (null: empty), each of about ``limit`` bytes."""
    for batch in batches:
        texts = [x or b"" for x in batch.column(column).to_pylist()]
        begin = size = 0
        for i, text in enumerate(texts):
            if size and size + len(text) > limit:
                yield batch.slice(begin, i - begin), texts[begin:i]
                begin, size = i, 0
            size += len(text) + 1
        if begin < len(texts):
            yield batch.slice(begin), texts[begin:]


def as_bytes(column: str | Column) -> Column:
    """A text column as UTF-8 bytes."""
    return (F.col(column) if isinstance(column, str) else column).cast("string").cast("binary")


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def small_batches(spark) -> None:
    """Few rows in each Arrow batch from now on, so that a batch of long texts is still small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def table(spark, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class HashArray:
    """Sorted 64-bit hashes with rows of values, found through an index on their top bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.bits = max(1, min(24, int(len(keys)).bit_length()))
        top = (keys >> U64(64 - self.bits)).astype(np.int64)
        self.begin = np.searchsorted(top, np.arange((1 << self.bits) + 1)).astype(np.int32)

    def find(self, query: np.ndarray) -> np.ndarray:
        """The row of each queried hash, or -1."""
        top = (query >> U64(64 - self.bits)).astype(np.int64)
        at, stop = self.begin[top], self.begin[top + 1]
        row = np.full(len(query), -1, np.int64)
        todo = np.flatnonzero(at < stop)
        while len(todo):
            here = at[todo]
            found = self.keys[here]
            wanted = query[todo]
            hit = found == wanted
            row[todo[hit]] = here[hit]
            at[todo] += 1
            todo = todo[(found < wanted) & (here + 1 < stop[todo])]
        return row
