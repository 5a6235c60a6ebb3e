"""Operator 11: best-fit packing with large-item matching.

A document is its token ids and one end id.  Only a document longer than a
sequence is cut, into full pieces behind a first piece that takes the rest.

The plan needs lengths alone, so it is made on their histogram, which has at most
``room`` bins whatever the table's size.  Lengths above a third of a sequence come
first: at most two of them fit in one, so greedy matching (the longest with the
longest that fits) uses as few sequences for them as can be.  Smaller lengths
then fill the remaining gaps, longest first, each the smallest gap that takes it;
new sequences open only when no gap does.  All sequences with one gap are one run
of numbers, and each step moves whole runs and splits one at most, so a plan has
a few runs for each length.  Pieces get gapless numbers inside their length, and
a run of these numbers has its place in the plan.

Ids are those of the ``tokenizers`` file.  Its merges are applied by ``tiktoken``
with the same ranks, which is five times faster; texts that hold the special token
or a very long run of white space, on which the two differ, go to ``tokenizers``.

Edge cases: null and empty texts are one end id; repeated rows are packed one by
one; very long texts give many pieces, tokenised as one text in one task's memory;
ties are ordered by id, piece, start and checksum, so rows that tie there are
equal; null ids count as an id below all others; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbering import gapless
from .storage import stored
from .textkit import table

ROOM, END = 1024, 2
#: Runs of white space from here on go to ``tokenizers``: the other's pattern may run out of stack.
LONG_GAP = re.compile(r"\s{5000}")


@functools.cache
def encoders(vocabulary: str, ranks: str):
    """The two encoders of a vocabulary, and its special tokens; once in each worker."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary)
    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    return slow, fast, [x.content for x in slow.get_added_tokens_decoder().values()]


def token_ids(text: str, vocabulary: str, ranks: str) -> list[int]:
    """The ids of a text by the vocabulary file, without special tokens added."""
    slow, fast, special = encoders(vocabulary, ranks)
    if any(x in text for x in special) or (len(text) >= 5000 and LONG_GAP.search(text)):
        return slow.encode(text, add_special_tokens=False).ids
    return fast.encode_ordinary(text)


def cut(n: int, room: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, behind a first one that takes the rest."""
    first = n % room or room
    return [(0, first), *((at, room) for at in range(first, n, room))]


def pieces(docs: DataFrame, vocabulary: str, ranks: str, room: int = ROOM, text: str = "text", id_col: str = "doc_id", end: int = END) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, x in enumerate(batch.column("text")):
                ids = token_ids(x.as_py() or "", vocabulary, ranks)
                ids.append(end)
                data = np.array(ids, "<u4").tobytes()
                for p, (at, n) in enumerate(cut(len(ids), room)):
                    row.append(i)
                    piece.append(p)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(data[4 * at : 4 * (at + n)]))
            columns = [batch.column("id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32"])

    numbers = "piece int, start long, length long, ids_crc32 long"
    out = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, {numbers}")
    return out.withColumnRenamed("id", id_col)


class Plan:
    """Places of lengths in sequences: runs of (length, first rank, sequence, pieces in each sequence, offset)."""

    def __init__(self, room: int):
        self.room = room
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.gaps: dict[int, list[tuple[int, int]]] = {}  # gap: (first sequence, how many)
        self.placed: dict[int, int] = {}
        self.sequences = 0

    def opened(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def put(self, length: int, n: int, first: int, each: int, offset: int) -> None:
        """n pieces from sequence ``first`` on, ``each`` in every one, from ``offset`` on."""
        rank = self.placed.get(length, 0)
        self.runs.append((length, rank, first, each, offset))
        self.placed[length] = rank + n

    def left(self, gap: int, first: int, n: int) -> None:
        if gap and n:
            self.gaps.setdefault(gap, []).append((first, n))

    def match(self, left: dict[int, int]) -> None:
        """Lengths above a third: the longest with the longest that fits, at most two in a sequence."""
        lengths = sorted(left, reverse=True)
        for length in lengths:
            while left[length]:
                n = left[length]
                other = next((x for x in lengths if x <= self.room - length and left[x] and (x != length or n > 1)), None)
                if other is None:
                    first = self.opened(n)
                    self.put(length, n, first, 1, 0)
                    self.left(self.room - length, first, n)
                    left[length] = 0
                elif other == length:
                    first = self.opened(n // 2)
                    self.put(length, n // 2 * 2, first, 2, 0)
                    self.left(self.room - 2 * length, first, n // 2)
                    left[length] = n % 2
                else:
                    n = min(n, left[other])
                    first = self.opened(n)
                    self.put(length, n, first, 1, 0)
                    self.put(other, n, first, 1, length)
                    self.left(self.room - length - other, first, n)
                    left[length] -= n
                    left[other] -= n

    def fill(self, length: int, n: int) -> None:
        """Smaller lengths: the smallest gap that takes one, again and again; a new sequence where none does."""
        while n:
            gap = min((g for g in self.gaps if g >= length), default=None)
            if gap is None:
                new = -(-n // (self.room // length))
                gap = self.room
                self.left(gap, self.opened(new), new)
            first, many = self.gaps[gap].pop()
            if not self.gaps[gap]:
                del self.gaps[gap]
            each = min(gap // length, n)
            full = min(n // each, many)
            self.put(length, full * each, first, each, self.room - gap)
            self.left(gap - each * length, first, full)
            self.left(gap, first + full, many - full)
            n -= full * each


def planned(lengths: dict[int, int], room: int) -> Plan:
    """The plan for a histogram of lengths, each of ``room`` at most."""
    plan = Plan(room)
    plan.match({x: n for x, n in lengths.items() if 3 * x > room})
    for length in sorted((x for x in lengths if 3 * x <= room), reverse=True):
        plan.fill(length, lengths[length])
    return plan


def best_fit(docs: DataFrame, vocabulary: str, ranks: str, room: int = ROOM, text: str = "text", id_col: str = "doc_id", end: int = END) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    cuts = stored(pieces(docs, vocabulary, ranks, room, text, id_col, end), "pieces")
    lengths = {r.length: r.n for r in cuts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # room rows at most
    plan = planned(lengths, room)
    runs = sorted(plan.runs)
    wide = 1 << 48  # ranks are below it
    begin = np.array([length * wide + rank for length, rank, *_ in runs], np.int64)
    rank0, first, each, offset = (np.array([x[i] for x in runs], np.int64) for i in (1, 2, 3, 4))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(begin, length * wide + rank, "right") - 1
            behind = rank - rank0[at]
            places = [pa.array(first[at] + behind // each[at]), pa.array(offset[at] + behind % each[at] * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *places], [*batch.schema.names[:-1], "sequence_id", "offset"])

    numbered = gapless(cuts, "length", [F.col(c) for c in (id_col, "piece", "start", "ids_crc32")], sum(lengths.values()), "rank").select(*cuts.columns, "rank")
    schema = T.StructType([*cuts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return numbered.mapInArrow(place, schema)


def op11_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
