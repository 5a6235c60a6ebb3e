"""Operator 13: vectors as short codes, by Lloyd's algorithm with heaps of bounds.

A vector's components become integers, floor(scale * x), and the vector is cut into
``parts`` equal parts.  Each part position has a codebook, which starts as that
part of the ``entries`` vectors with the smallest ids.  A round assigns every part
to its nearest entry and replaces each entry by the mean of its parts, rounded
down; after ``rounds`` rounds the parts are assigned once more.

A part keeps one number from round to round: its distance to the next nearest
entry minus that to its own (lower bound minus upper bound), plus the drift that
its entry had run up when this was measured.  When entries move, the drift of
entry e grows by its own movement and by the largest movement of any other, which
is the most that the slack of its parts can have lost.  In a task, the parts of an
entry are a heap by that number; those whose slack the drift has used up are popped
from the top and measured against all entries again, and no others are looked at.
Tasks add up what moved parts change in counts and sums, and Spark adds these up.

A round reads and writes one table of rows (vector, codes, slacks), without a
shuffle; only the changes of the ``parts * entries`` entries are shuffled.  When the
next table is written the last one is deleted.  The driver holds the codebooks alone.

Squared distances are whole numbers.  Where they and their sums are below 2^53 they
are computed in doubles, exactly; otherwise as Python integers.  Bounds are kept a
little too tight, by more than their rounding, so they never hide a nearer entry.

Edge cases: null vectors and those with a null or non-finite component are dropped,
as are those that don't have as many components as the first kept vector by id (an
empty one included); its number of components must divide by ``parts``.  Ties go to
the lower entry.  Rows with the same id are coded one by one, and of those the
smaller vector starts first; null ids come after all others.  With fewer vectors than
entries the codebooks have fewer entries.  Entries without parts stay.  An empty
table gives an empty result; errors beyond 64 bits are an error; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import drop, stored, stored_at
from .textkit import table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors whose heaps a task holds at a time.
HEAP_ROWS = 32_768
#: Bounds give away this share, and this much, for rounding.
SLACK = 1e-9


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as doubles where sums of squares of differences are exact in them, else as Python integers."""
    x = np.asarray(x, float)
    if x.size and 4.0 * x.shape[-1] * (scale * np.abs(x).max()) ** 2 >= 2.0**51:
        return np.array([[int(v) * scale if abs(v) >= 2.0**52 else floor(v * scale) for v in row] for row in x.tolist()], object)
    return np.floor(x * scale)


def squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries."""
    if x.dtype == object or book.dtype == object:
        return np.stack([((x.astype(object) - entry) ** 2).sum(1) for entry in book.astype(object)], 1)
    return (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row (ties: the lower), and how much farther the next nearest is, a little less than that."""
    code, slack = np.empty(len(x), np.int64), np.empty(len(x))
    for at in range(0, len(x), 4096):
        d = squares(x[at : at + 4096], book)
        rows = np.arange(len(d))
        own = d.argmin(1)
        near = np.sqrt(d[rows, own].astype(float))
        if len(book) > 1:
            d = d.astype(float)
            d[rows, own] = np.inf
            far = np.sqrt(d.min(1))
        else:
            far = np.full(len(d), np.inf)
        code[at : at + 4096] = own
        slack[at : at + 4096] = far * (1 - SLACK) - near * (1 + SLACK)
    return code, slack


class Heaps:
    """The parts of one position in a task: for each entry a heap of (slack, row)."""

    def __init__(self, codes: np.ndarray, slacks: np.ndarray):
        self.codes, self.slacks = codes.astype(np.int64), slacks.copy()
        self.heaps: dict[int, list[tuple[float, int]]] = {}
        order = np.argsort(self.codes, kind="stable")
        at = 0
        for entry, n in zip(*np.unique(self.codes, return_counts=True), strict=True):
            rows = order[at : at + n]
            heap = list(zip(self.slacks[rows].tolist(), rows.tolist(), strict=True))
            heapify(heap)
            self.heaps[int(entry)] = heap
            at += n

    def violated(self, drift: np.ndarray) -> np.ndarray:
        """Pops the rows whose slack their entry's drift has used up."""
        out = []
        for entry, heap in self.heaps.items():
            limit = float(drift[entry]) * (1 + SLACK) + SLACK
            while heap and heap[0][0] <= limit:
                out.append(heappop(heap)[1])
        return np.array(out, np.int64)

    def push(self, rows: np.ndarray, codes: np.ndarray, slacks: np.ndarray) -> None:
        self.codes[rows], self.slacks[rows] = codes, slacks
        for row, code, slack in zip(rows.tolist(), codes.tolist(), slacks.tolist(), strict=True):
            heappush(self.heaps.setdefault(code, []), (slack, row))


def changes(x: np.ndarray, old: np.ndarray | None, new: np.ndarray, entries: int) -> Iterator[tuple[int, int, list[int]]]:
    """(entry, change of its count, change of its sums) from parts that got another entry."""
    moved = np.arange(len(x)) if old is None else np.flatnonzero(old != new)
    count = np.zeros(entries, np.int64)
    total = np.zeros((entries, x.shape[1]), object if x.dtype == object else float)
    for codes, sign in ((new, 1), (old, -1)):
        if codes is not None:
            np.add.at(count, codes[moved], sign)
            np.add.at(total, codes[moved], sign * x[moved])
    for e in np.unique(np.concatenate([y[moved] for y in (old, new) if y is not None])):
        yield int(e), int(count[e]), [int(v) for v in total[e]]


def step(books: list[np.ndarray], drifts: np.ndarray, scale: int, final: bool):
    """Assigns the parts of a task's rows; without codes all of them, else those whose slack is used up."""
    n_parts, entries = len(books), len(books[0])
    width = books[0].shape[1]

    def settled(held: pa.Table) -> Iterator[pa.RecordBatch]:
        flat = held["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        x = whole(flat.reshape(len(held), n_parts * width), scale)
        first = held["codes"].null_count > 0
        codes = np.zeros((len(held), n_parts), np.int64)
        slacks = np.zeros((len(held), n_parts))
        if not first:
            codes[:] = np.frombuffer(b"".join(held["codes"].to_pylist()), np.uint16).reshape(codes.shape)
            slacks[:] = np.frombuffer(b"".join(held["slacks"].to_pylist()), float).reshape(slacks.shape)
        moves = []
        error = np.zeros(len(held), x.dtype)
        for p, book in enumerate(books):
            own = x[:, p * width : (p + 1) * width]
            old = None if first else codes[:, p].copy()
            if first:
                codes[:, p], slacks[:, p] = nearest(own, book)
                slacks[:, p] += drifts[p][codes[:, p]]
            else:
                heaps = Heaps(codes[:, p], slacks[:, p])
                rows = heaps.violated(drifts[p])
                found, slack = nearest(own[rows], book)
                heaps.push(rows, found, slack + drifts[p][found])
                codes[:, p], slacks[:, p] = heaps.codes, heaps.slacks
            if final:
                error = error + ((own - book[codes[:, p]]) ** 2).sum(1)
            else:
                moves += [(p * entries + e, n, s) for e, n, s in changes(own, old, codes[:, p], entries)]
        as_rows = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
        if final:
            code = ["".join(f"{c:02x}" for c in r) for r in codes.tolist()]
            yield from pa.table([held["id"], held["label"], pa.array(code), pa.array([int(e) for e in error], pa.int64())], ["id", "label", "code", "error"]).to_batches()
            return
        n = len(held)
        none = lambda k, kind: pa.nulls(k, kind)
        names = ["id", "label", "vector", "codes", "slacks", "slot", "n", "s"]
        kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()))
        rows = [*(held[c] for c in ("id", "label", "vector")), as_rows(codes.astype(np.uint16)), as_rows(slacks), *(none(n, k) for k in kinds)]
        yield from pa.table(rows, names).to_batches()
        cells = [pa.array([m[i] for m in moves], k) for i, k in enumerate(kinds)]
        sides = [none(len(moves), held[c].type) for c in ("id", "label", "vector")] + [none(len(moves), pa.binary())] * 2
        yield from pa.table([*sides, *cells], names).to_batches()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= HEAP_ROWS:
                yield from settled(pa.Table.from_batches(held))
                held, n = [], 0
        if held:
            yield from settled(pa.Table.from_batches(held))

    return run


def moved_books(state: DataFrame, books: list[np.ndarray], counts: np.ndarray, sums: np.ndarray) -> list[np.ndarray]:
    """The next codebooks, from the changes that the tasks wrote; ``counts`` and ``sums`` are kept up."""
    width = books[0].shape[1]
    found = state.where("slot is not null").groupBy("slot").agg(F.sum("n"), *[F.sum(F.col("s")[i]) for i in range(width)])
    for slot, n, *s in found.collect():  # a row for each entry that changed
        counts[slot] += n
        sums[slot] += np.array(s, object)
    out = []
    for p, book in enumerate(books):
        new = book.astype(object)
        for e in range(len(book)):
            if counts[p * len(book) + e]:
                new[e] = sums[p * len(book) + e] // counts[p * len(book) + e]
        out.append(tidy(new))
    return out


def tidy(book: np.ndarray) -> np.ndarray:
    """Integers as doubles where sums of squares of differences are exact in them."""
    most = max((abs(v) for v in book.ravel().tolist()), default=0)
    return book.astype(float) if 4 * book.shape[1] * most**2 < 1 << 51 else book


def movement(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How much slack each entry's parts can lose: its own movement and the largest of the others'."""
    own = np.sqrt(((new - old) ** 2).sum(1).astype(float)) * (1 + SLACK)
    if len(own) < 2:
        return own
    order = np.argsort(own)
    other = np.full(len(own), own[order[-1]])
    other[order[-1]] = own[order[-2]]
    return own + other


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, list[np.ndarray]]:
    """Rows (id, label, code, error) and the final codebooks, one array of entries for each part position."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector")).where(F.col("vector").isNotNull() & good & (F.size("vector") > 0))
    order = [F.col("id").asc_nulls_last(), F.col("vector")]
    plain = T.StructType([T.StructField(c, rows.schema[c].dataType) for c in ("id", "label")])  # rows of changes have nulls there
    coded = T.StructType([*plain.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    firsts = lambda of: [r[0] for r in of.orderBy(*order).limit(entries).select("vector").collect()]
    start = firsts(rows)
    if not start:
        return vectors.sparkSession.createDataFrame([], coded), []
    size = len(start[0])
    if size % parts:
        raise ValueError(f"{size} components can't be cut into {parts} equal parts")
    width = size // parts
    rows = rows.where(F.size("vector") == size)
    if any(len(x) != size for x in start):
        start = firsts(rows)
    start = whole(np.array(start, float), scale).astype(object)
    books = [tidy(np.array([[int(v) for v in r] for r in start[:, p * width : (p + 1) * width]], object)) for p in range(parts)]
    counts, sums = np.zeros(parts * len(start), object), np.zeros((parts * len(start), width), object)
    drifts = np.zeros((parts, len(start)))
    kept = T.StructType([*plain.fields, T.StructField("vector", T.ArrayType(vectors.schema[vector].dataType.elementType)), T.StructField("codes", T.BinaryType()), T.StructField("slacks", T.BinaryType())])
    changed = [T.StructField("slot", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("s", T.ArrayType(T.LongType()))]
    state = rows.select("*", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("binary").alias("slacks"))
    spark, last = vectors.sparkSession, None
    for _ in range(rounds):
        state, path = stored_at(state.mapInArrow(step(books, drifts, scale, False), T.StructType([*kept.fields, *changed])), "codes")
        if last:
            drop(spark, last)
        last = path
        new = moved_books(state, books, counts, sums)
        drifts = drifts + np.array([movement(a.astype(object), b.astype(object)) for a, b in zip(books, new, strict=True)])
        books = new
        state = state.where("slot is null").select(*kept.names)
    out = stored(state.mapInArrow(step(books, drifts, scale, True), coded), "codes")
    if last:
        drop(spark, last)
    return out, books


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(str(int(v)) for book in books for v in book.ravel().tolist()).encode()).hexdigest()


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
