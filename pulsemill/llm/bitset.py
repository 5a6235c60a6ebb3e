"""A broadcast filter of fixed size over 64-bit hashes; it only saves shuffles, joins decide."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import U64

#: 8 MB, whatever the size of the data.
BITS = 26
BLOCK = 16


def bitset(df: DataFrame, column: str) -> Broadcast:
    """The broadcast bit set of the top BITS bits of a long column; built in Spark, 8 KB a block."""
    bit = F.shiftrightunsigned(F.col(column), 64 - BITS)
    places = df.select(F.shiftright(bit, BLOCK).alias("block"), (bit % (1 << BLOCK)).alias("at")).distinct()

    def fill(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << BLOCK, bool)
        bits[table["at"].to_numpy()] = True
        return pa.table({"block": table["block"][:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(1 << (BITS - 3), np.uint8)
    step = 1 << (BLOCK - 3)
    for row in places.groupBy("block").applyInArrow(fill, "block long, bits binary").toLocalIterator():
        out[row.block * step : (row.block + 1) * step] = np.frombuffer(row.bits, np.uint8)
    return df.sparkSession.sparkContext.broadcast(out)


def hit(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the unsigned hashes may be in the set."""
    at = (hashes >> U64(64 - BITS)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
