"""Nearest neighbours of all rows, and a layout of their graph in the plane (inventory M12).

The neighbour graph is found in two steps, neither of which forms all pairs of a
large table: rows are put in an order by the signs of random projections several
times, and each stretch of an order is searched in full; then the rows are cut into
cells about k-means centres, and each row visits the cells nearest to it, a few a
round, until few pairs change.  A vector moves once for each cell that its row
visits; what moves back are the pairs that beat the row's farthest neighbour.  The
layout moves the rows' places by the graph's attraction and by repulsion from random
rows, an epoch for a pass over the edges.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..functions.columns import over
from ..sources.staging import staged

#: Rows of a stretch that are compared with each other; each row is in two of an order.
STRETCH = 512
#: Rows of a task of an order, about.
TASK_ROWS = 16_384
#: Rows of a cell at most, about; numbers of its vectors at most; cells that a row visits in a round; rows that visit a cell in one task, about.
#: A vector moves once for each cell that its row visits and once for each task that its own cell has, so large cells move less.
CELL_ROWS, CELL_VALUES, VISITS, GUESTS = 65_536, 1 << 23, 4, 65_536
#: Rows of a cell that half a stretch of visitors is compared with at once.
BLOCK = 2048
GRAPH = "id long, other long, distance double"


def rows_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(whole), -1)


def gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of x to those of y."""
    scale = (x * x).sum(-1)[..., :, None] + (y * y).sum(-1)[..., None, :]
    square = np.maximum(scale - 2 * x @ y.swapaxes(-1, -2), 0)
    near = np.nonzero(square <= 1e-6 * scale)  # differences of almost equal numbers
    square[near] = ((x[*near[:-2], near[-2]] - y[*near[:-2], near[-1]]) ** 2).sum(-1)
    return np.sqrt(square)


def straight(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Euclidean distances of some rows of x to some of y, pair by pair."""
    parts = [np.sqrt(((x[i[a : a + 65_536]] - y[j[a : a + 65_536]]) ** 2).sum(1)) for a in range(0, len(i), 65_536)]
    return np.concatenate([np.zeros(0), *parts])


def least(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, distance: np.ndarray, k: int) -> pa.RecordBatch:
    """The k nearest others of each row of a matrix of distances, without itself; their distances are taken from the vectors again, so that each pair has one at all places."""
    distance = np.where(ids[:, None] == others[None, :], np.inf, distance)
    k = min(k, distance.shape[1])
    at = np.argpartition(distance, k - 1, 1)[:, :k]
    i, j = np.nonzero(np.isfinite(np.take_along_axis(distance, at, 1)))
    j = at[i, j]
    return pa.RecordBatch.from_arrays([pa.array(ids[i], pa.int64()), pa.array(others[j], pa.int64()), pa.array(straight(x, y, i, j))], ["id", "other", "distance"])


def nearest(pairs: DataFrame, k: int, keep: Sequence[str] = ()) -> DataFrame:
    """The k nearest distinct others of each row, by distance and then by id."""
    once = pairs.repartition("id").groupBy("id", "other").agg(F.min("distance").alias("distance"), *[F.max(c).alias(c) for c in keep])
    rank = F.row_number().over(over(["id"], ["distance", "other"]))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)


def vectors(df: DataFrame, row_id: str, values: str) -> DataFrame:
    """Rows (id, v); floats stay floats, as they are half as long where they move, and distances are of doubles in any case."""
    kind = df.schema[values].dataType
    floats = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    return df.select(F.col(row_id).cast("long").alias("id"), F.col(values).cast("array<float>" if floats else "array<double>").alias("v"))


def stretches(rows: DataFrame, k: int, orders: int, seed: int) -> DataFrame:
    """Pairs (id, other, distance) of near rows from ``orders`` random orders of the rows (id, v)."""
    size = len(rows.first()["v"])
    n = rows.count()
    bits = max(0, min(20, (n // STRETCH).bit_length()))
    planes = np.random.default_rng(seed).normal(0, 1, (orders, bits + 1, size))

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = rows_matrix(batch.column("v")) @ planes.reshape(-1, size).T
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.tolist(), pa.list_(pa.float64()))], ["id", "v", "at"])

    placed = staged(rows.select("id", "v").mapInArrow(project, f"id long, v {rows.schema['v'].dataType.simpleString()}, at array<double>"), "projected")
    middle = placed.agg(*[F.percentile_approx(F.col("at")[i], 0.5, 1000) for i in range(orders * (bits + 1))]).first()
    codes = []
    for o in range(orders):
        code = F.lit(0)
        for b in range(bits):
            code = code * 2 + (F.col("at")[o * (bits + 1) + b] > middle[o * (bits + 1) + b]).cast("int")
        codes.append(F.struct(F.lit(o).alias("order"), code.alias("code"), F.col("at")[o * (bits + 1) + bits].alias("along")))
    dealt = placed.select("id", "v", F.explode(F.array(*codes)).alias("key")).select("id", "v", "key.*")
    parts = max(1, -(-n * orders // TASK_ROWS))
    dealt = dealt.repartitionByRange(parts, "order", "code", "along", "id").sortWithinPartitions("order", "code", "along", "id")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half, before, held = STRETCH // 2, None, []

        def seen(part: tuple, last: tuple | None) -> tuple:
            """The part with the matrices of distances to itself and to the half before it; that one gets its distances to the part."""
            (ids, x, order), found = part, []
            for other_ids, y, other_order, *_ in ([part] if last is None else [part, last]):
                found.append((other_ids, y, np.where(order[:, None] == other_order[None, :], gaps(x, y), np.inf)))
            if last is not None:
                last[3].append((ids, x, found[1][2].T))
            return (*part, found)

        def done(part: tuple) -> pa.RecordBatch:
            """A half's rows and their nearest in it and in the halves to both sides."""
            others, y, d = zip(*part[3], strict=True)
            return least(part[0], part[1], np.concatenate(others), np.concatenate(y), np.concatenate(d, 1), k)

        for batch in batches:
            held.append((batch.column("id").to_numpy(), rows_matrix(batch.column("v")), batch.column("order").to_numpy()))
            ids, x, order = (np.concatenate([h[i] for h in held]) for i in range(3))
            held = []
            while len(ids) >= half:
                part = seen((ids[:half], x[:half], order[:half]), before)
                if before is not None:
                    yield done(before)
                before, (ids, x, order) = part, (ids[half:], x[half:], order[half:])
            if len(ids):
                held = [(ids, x, order)]
        if held:
            part = seen(held[0], before)
            if before is not None:
                yield done(before)
            before = part
        if before is not None:
            yield done(before)

    return dealt.select("id", "v", "order").mapInArrow(search, GRAPH)


def routed(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """Rows (id, v, cells, bounds): the ``most`` cells nearest to each row (id, v), its own first, and how near their rows can be at least.

    A cell holds the rows of a k-means centre, or a part of them where they are more
    than the cell's limit.  A row of another centre's cell lies behind the plane between both
    centres, so it can't be nearer than that.
    """
    n, size = rows.count(), len(rows.first()["v"])
    limit = max(1, min(CELL_ROWS, CELL_VALUES // size))
    k = -(-n // limit)
    centres = np.zeros((1, size))
    if k > 1:
        model = KMeans(k=k, seed=seed, maxIter=4, initMode="random", featuresCol="__f").fit(rows.select(array_to_vector(F.col("v").cast("array<double>")).alias("__f")))
        centres = np.array(model.clusterCenters())
    apart = gaps(centres, centres)
    kind = rows.schema["v"].dataType.simpleString()

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = gaps(rows_matrix(batch.column("v")), centres).argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], ["id", "v", "deal", "centre"])

    deal = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)).alias("deal")
    own = staged(rows.select("id", "v", deal).mapInArrow(assign, f"id long, v {kind}, deal long, centre int"), "assigned")
    parts = np.ones(len(centres), np.int64)
    for centre, size in own.groupBy("centre").count().collect():  # a number for each centre
        parts[centre] = -(-size // limit)
    first = np.cumsum(parts) - parts
    centre_of = np.repeat(np.arange(len(centres)), parts)
    m = min(most, len(centre_of))

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d, centre = gaps(rows_matrix(batch.column("v")), centres), batch.column("centre").to_numpy()
                mine = d[np.arange(len(d)), centre]
                d[np.arange(len(d)), centre] = -1  # its own first
                cell = first[centre] + batch.column("deal").to_numpy() % parts[centre]
                far = d[:, centre_of]
                far[np.arange(len(d)), cell] = -2
                at = np.argpartition(far, m - 1, 1)[:, :m]
                at = np.take_along_axis(at, np.argsort(np.take_along_axis(far, at, 1), 1, kind="stable"), 1)
                other = centre_of[at]
                to = np.take_along_axis(d, other, 1)
                between = apart[centre[:, None], other]
                bound = np.where(to < 0, 0, (to * to - (mine * mine)[:, None]) / np.maximum(2 * between, 1e-300))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(at.tolist(), pa.list_(pa.int32())), pa.array(np.maximum(bound, 0).tolist(), pa.list_(pa.float64()))], ["id", "v", "cells", "bounds"])

    return staged(own.mapInArrow(route, f"id long, v {kind}, cells array<int>, bounds array<double>"), "routed")


def finder(y: np.ndarray):
    """A search for the rows of y that are near to others.

    Floats choose: one product gives lower bounds of all squared distances about the
    rows' mean, less by more than their rounding.  Distances of what they let through
    are taken from the vectors themselves.
    """
    centre = y.mean(0)
    centre = np.where(np.isfinite(centre), centre, 0)
    d = y.shape[1]
    most = lambda z: np.abs(z, where=np.isfinite(z), out=np.zeros_like(z)).max(initial=0)
    largest = max(most(y), most(centre))

    def lifted(z: np.ndarray, kind: type, guest: bool) -> np.ndarray:
        z = z - centre
        scale = (1 - (d + 8) * 2 * float(np.finfo(kind).eps)) * (z * z).sum(1)
        ones = np.ones(len(z))
        return np.column_stack([-2 * z, scale, ones] if guest else [z, ones, scale]).astype(kind)

    held: dict[type, np.ndarray] = {}

    def within(x: np.ndarray, far: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, distance) of at least the k nearest rows of y to each row of x that are no farther than ``far``."""
        top = max(largest, most(x))
        kind = np.float32 if top < 1e15 else np.float64
        if kind not in held:
            held[kind] = lifted(y, kind, False).T
        guests = lifted(x, kind, True)

        def bound(d_max: np.ndarray) -> np.ndarray:
            with np.errstate(over="ignore"):
                square = (d_max * (1 + 1e-9) + 8 * d**0.5 * np.finfo(float).eps * top) ** 2 + float(np.finfo(kind).tiny) * (d + 2)
                return np.nextafter(square.astype(kind), kind(np.inf))[:, None]

        def chosen(most_low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Pairs of guests with rows whose lower bound is within the limit; a block of rows at a time stays in the cache."""
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for a in range(0, len(y), BLOCK):
                i, j = np.divmod(np.flatnonzero(guests @ held[kind][:, a : a + BLOCK] <= most_low), min(BLOCK, len(y) - a))
                out.append((i, a + j))
            return tuple(np.concatenate(c) for c in zip(*out, strict=True))

        with np.errstate(over="ignore", invalid="ignore"):
            # rows that have more than they need get a nearer limit: the k with the least bounds are as near as the k nearest at least
            tight = far.copy()
            some = np.arange(0, len(y), max(1, len(y) // 1024))
            loose = np.flatnonzero(np.count_nonzero(guests @ held[kind][:, some] <= bound(far), 1) > max(2 * k, 16) * len(some) / len(y) * 8)
            if len(loose) and len(y) > 2 * k:
                at = np.argpartition(guests[loose] @ held[kind], k - 1, 1)[:, :k]
                kth = straight(x, y, np.repeat(loose, k), at.ravel()).reshape(-1, k).max(1)
                tight[loose] = np.fmin(far[loose], np.where(np.isfinite(kth), kth, np.inf))
            i, j = chosen(bound(tight))
        gap = straight(x, y, i, j)
        near = gap <= far[i]
        return i[near], j[near], gap[near]

    return within


def visited(rows: DataFrame, graph: DataFrame, k: int, turn: int) -> DataFrame:
    """Pairs (id, other, distance) of rows with rows of the VISITS cells that are theirs in this turn, where they are no farther than the farthest of k neighbours.

    Cells that can't hold such a row are left out.  Where many rows visit a cell its
    rows are sent to several tasks, each with some of the visitors.
    """
    far = graph.groupBy("id").agg(F.when(F.count("*") >= k, F.max("distance")).otherwise(float("inf")).alias("far"))
    turns = F.slice(F.arrays_zip("cells", "bounds"), turn * VISITS + 1, VISITS)
    asked = rows.select("id", F.explode(turns).alias("at")).select("id", F.col("at.cells").alias("cell"), F.col("at.bounds").alias("bound"))
    asked = asked.join(far, "id", "left").withColumn("far", F.coalesce("far", F.lit(float("inf")))).where(F.col("bound") <= F.col("far") * (1 + 1e-6))
    asked = staged(asked.select("id", "cell", "far"), "visits")
    tasks = staged(asked.groupBy("cell").agg(F.ceil(F.count("*") / GUESTS).cast("int").alias("tasks")), "tasks")  # a row for each cell
    dealt = asked.join(F.broadcast(tasks), "cell").select("id", "cell", F.pmod(F.xxhash64("id", F.lit(turn)), F.col("tasks")).cast("int").alias("task"), "far")
    guests = rows.select("id", "v").join(dealt, "id").select(*[F.col(c).alias(c) for c in ("cell", "task", "id", "v", "far")])  # apart from the columns of hosts
    hosts = rows.select("id", "v", F.col("cells")[0].alias("cell")).join(F.broadcast(tasks), "cell")
    hosts = hosts.select("cell", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), "id", "v")

    def compare(own: pa.Table, others: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if own.num_rows and others.num_rows:
            ids, guest, far = own["id"].to_numpy(), others["id"].to_numpy(), others["far"].to_numpy()
            within = finder(rows_matrix(own["v"]))
            for a in range(0, others.num_rows, STRETCH // 2):
                some = others.slice(a, STRETCH // 2)
                i, j, d = within(rows_matrix(some["v"]), far[a : a + STRETCH // 2], k + 1)
                u, v = guest[a + i], ids[j]
                u, v, d, i = (c[u != v] for c in (u, v, d, i))
                at = np.lexsort((v, d, i))
                i = i[at]
                at = at[np.arange(len(at)) - np.searchsorted(i, i) < k]
                out.append((u[at], v[at], d[at]))
        return pa.table(dict(zip(("id", "other", "distance"), (pa.array(np.concatenate(c)) for c in zip(*out, strict=True)), strict=True)))

    return hosts.groupBy("cell", "task").cogroup(guests.groupBy("cell", "task")).applyInArrow(compare, GRAPH)


def neighbour_graph(df: DataFrame, row_id: str, values: str, k: int = 15, orders: int = 6, rounds: int = 8, pool: int | None = None, settled: float = 0.002, seed: int = 10) -> DataFrame:
    """Rows (id, other, distance, rank): the k nearest others of every row by Euclidean distance, nearly all of them right.

    ``row_id`` must be a distinct whole number.  A row visits VISITS cells a round.  Rounds
    end when less than the share ``settled`` of the pairs is new, or all cells have been
    visited; then the result is exact.  ``pool`` neighbours are held meanwhile (k, if none is
    given).  Of a table of k rows or fewer, all others are neighbours.
    """
    rows = staged(vectors(df, row_id, values), "rows")
    if rows.isEmpty():
        return df.sparkSession.createDataFrame([], f"{GRAPH}, rank int")
    least_k, k = k, max(k, pool or k)
    graph = staged(nearest(stretches(rows, k, orders, seed), k), "neighbours")
    places = routed(rows, VISITS * rounds, seed) if rounds else rows
    for turn in range(rounds):
        if turn and places.where(F.size("cells") > turn * VISITS).isEmpty():
            break
        found = visited(places, graph, k, turn).withColumn("old", F.lit(False))
        known = graph.select("id", "other", "distance", F.lit(True).alias("old"))
        graph = staged(nearest(known.unionByName(found), k, ["old"]), "neighbours")
        new, n = graph.agg(F.count_if(~F.col("old")), F.count("*")).first()
        if new < settled * n:
            break
    return graph.where(F.col("rank") <= least_k).select("id", "other", "distance", "rank")


# ---- layout ------------------------------------------------------------------------

#: The curve 1 / (1 + A d^(2 B)) for a least distance of 0.1 in the plane, the largest move, and random rows for each edge.
A, B, MOST, NEGATIVES = 1.577, 0.895, 4.0, 5
#: Rows of a strip that a task lays out, and random rows that a round's repulsion is drawn from.
STRIP_ROWS, ANCHORS = 16_384, 4096


def memberships(graph: DataFrame) -> DataFrame:
    """Rows (u, v, w) with u < v: how far two rows belong together.

    A row's neighbour has exp(-(d - r) / s), with r the distance of its nearest other
    place and s such that a row's weights add up to log2 of their number; both
    directions are joined by a + b - a b.
    """
    return sides(graph).drop("forth")


def sides(graph: DataFrame) -> DataFrame:
    """Memberships (u, v, w, forth); forth: u has v among its neighbours."""
    lists = graph.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("distance", "other"))).alias("near"))  # k of each row

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = batch.column("near")
            d, other = (near.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            at = near.offsets.to_numpy()
            n = np.diff(at)
            row = np.repeat(np.arange(len(n)), n)
            r = np.full(len(n), np.inf)
            np.minimum.at(r, row[d > 0], d[d > 0])
            over_r = np.maximum(d - np.where(np.isfinite(r), r, 0)[row], 0)
            low, high, goal = np.zeros(len(n)), np.full(len(n), np.inf), np.log2(np.maximum(n, 2))
            s = np.ones(len(n))
            for _ in range(64):
                total = np.bincount(row, np.exp(-over_r / s[row]), len(n))
                high, low = np.where(total > goal, s, high), np.where(total > goal, low, s)
                s = np.where(np.isfinite(high), (low + high) / 2, s * 2)
                s = np.clip(s, 1e-12, 1e12)
            ids = batch.column("id").to_numpy()[row]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids, other)), pa.array(np.maximum(ids, other)), pa.array(np.exp(-over_r / s[row])), pa.array(ids < other)], ["u", "v", "w", "forth"])

    both = lists.mapInArrow(weigh, "u long, v long, w double, forth boolean").groupBy("u", "v")
    return both.agg((F.sum("w") - F.when(F.count("*") > 1, F.min("w") * F.max("w")).otherwise(0.0)).alias("w"), F.max("forth").alias("forth"))


def pulled(y: np.ndarray, head: np.ndarray, tail: np.ndarray, free: np.ndarray, step: float) -> None:
    """Moves both ends of edges towards each other, free ones alone."""
    gap = y[head] - y[tail]
    square = (gap * gap).sum(1)
    with np.errstate(divide="ignore"):
        force = np.where(square > 0, -2 * A * B * square ** (B - 1) / (1 + A * square**B), 0)
    move = step * np.clip(force[:, None] * gap, -MOST, MOST)
    np.add.at(y, head, move)
    np.add.at(y, tail, -move * free[tail, None])


def pushed(y: np.ndarray, head: np.ndarray, away: np.ndarray, step: float) -> None:
    """Moves rows away from random ones."""
    gap = y[head] - y[away]
    square = (gap * gap).sum(1)
    force = 2 * B / ((0.001 + square) * (1 + A * square**B))
    move = np.where(square[:, None] > 0, np.clip(force[:, None] * gap, -MOST, MOST), MOST * (head != away)[:, None])
    np.add.at(y, head, step * move)


def strip_epochs(anchors: np.ndarray, first: int, epochs: int, last: int, seed: int):
    """Lays out the rows (id, x, y, edges) of a strip by edge sampling for some epochs; linked rows (id, x, y) of other strips and random rows outside it keep their places."""

    def run(rows: pa.Table, linked_to: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")  # draws don't depend on the order in which rows arrive
        own, edges = rows["id"].to_numpy(), rows["edges"].combine_chunks()
        ids, at = np.unique(np.concatenate([own, linked_to["id"].to_numpy(), anchors["id"]]), return_inverse=True)
        y = np.zeros((len(ids), 2))
        y[at] = np.concatenate([*(np.stack([t[c].to_numpy() for c in "xy"], 1) for t in (rows, linked_to)), anchors["y"]])
        other, w = (edges.flatten().field(i).to_numpy() for i in (0, 1))
        head, tail, random = np.repeat(at[: len(own)], np.diff(edges.offsets.to_numpy())), np.searchsorted(ids, other), at[len(at) - len(anchors) :]
        free = np.zeros(len(ids))
        free[head] = 1
        linked = w > 0
        chance = w / max(w.max(), 1e-300)
        rng = np.random.default_rng([seed, first, int(own.min())])
        size = max(1, int(free.sum()) // 2)
        for epoch in range(first, first + epochs):
            step = 1 - epoch / last
            some = np.flatnonzero(linked & (rng.random(len(w)) < chance))
            rng.shuffle(some)
            for begin in range(0, len(some), size):
                part = some[begin : begin + size]
                pulled(y, head[part], tail[part], free, step)
                for _ in range(NEGATIVES):
                    pushed(y, head[part], rng.choice(random, len(part)), step)
        mine = np.flatnonzero(free)
        return pa.table({"id": pa.array(ids[mine], pa.int64()), "x": y[mine, 0], "y": y[mine, 1]})

    return run


def layout(df: DataFrame, row_id: str, values: str, k: int = 30, rounds: int = 10, epochs: int = 20, seed: int = 10, graph: DataFrame | None = None) -> DataFrame:
    """Rows (row_id, x, y): places in the plane that keep neighbours together, from the two leading components on.

    In each round the rows are cut into strips of about STRIP_ROWS along a direction
    that turns from round to round, and a task for each strip goes over its rows'
    edges ``epochs`` times, choosing an edge as often as it is strong.  A row has k
    edges at most, as an edge belongs to the row that found it; random rows that push
    are drawn from ANCHORS rows chosen anew in each round.
    """
    rows = staged(vectors(df, row_id, values), "rows")
    n = rows.count()
    if n < 3:
        return rows.select(F.col("id").alias(row_id), F.lit(0.0).alias("x"), F.col("id").cast("double").alias("y"))
    graph = neighbour_graph(rows, "id", "v", k) if graph is None else graph
    # an edge belongs to its first row if that found it, else to the other
    owner, far = (F.when(F.col("forth"), F.col(a)).otherwise(F.col(b)) for a, b in ("uv", "vu"))
    owned = sides(graph).select(owner.alias("id"), F.struct(far.alias("other"), "w").alias("edge"))
    owned = owned.groupBy("id").agg(F.sort_array(F.collect_list("edge")).alias("edges"))  # k of each row at most
    alone = F.array(F.struct(F.col("id").alias("other"), F.lit(0.0).alias("w")))  # so that each row has one
    edges = staged(rows.select("id").join(owned, "id", "left").select("id", F.coalesce("edges", alone).alias("edges")), "edges")
    placed = PCA(k=min(2, len(rows.first()["v"])), inputCol="__f", outputCol="__p").fit(at := rows.withColumn("__f", array_to_vector(F.col("v").cast("array<double>")))).transform(at)
    start = placed.select("id", vector_to_array("__p").alias("p"))
    flat = F.element_at("p", -1)
    wide = start.agg(*[F.max(F.abs(c)) for c in (F.col("p")[0], flat)], *[F.avg(c) for c in (F.col("p")[0], flat)]).first()
    scale = 10 / max(wide[0], wide[1], 1e-300)
    noise = lambda s: (F.pmod(F.xxhash64("id", F.lit(s)), F.lit(10_000)) / 1e4 - 0.5) * 1e-3  # noqa: E731  # rows with equal vectors come apart
    y = staged(start.select("id", ((F.col("p")[0] - wide[2]) * scale + noise(0)).alias("x"), ((flat - wide[3]) * scale + noise(1)).alias("y")), "places")
    strips = max(1, -(-n // STRIP_ROWS))
    for r in range(rounds):
        angle = np.pi * r * 0.618
        along = F.col("x") * float(np.cos(angle)) + F.col("y") * float(np.sin(angle))
        dealt = staged(y.repartitionByRange(strips, along, "id").withColumn("strip", F.spark_partition_id()), "strips")
        some = dealt.orderBy(F.xxhash64("id", F.lit(r)), "id").limit(ANCHORS).select("id", "x", "y").toPandas()
        anchors = np.zeros(len(some), [("id", np.int64), ("y", float, 2)])
        anchors["id"], anchors["y"] = some.id.to_numpy(), some[["x", "y"]].to_numpy()
        # a strip gets the place of a row outside it once, not once for each edge
        held = edges.join(dealt, "id").select("strip", "id", "x", "y", "edges")
        asked = held.select(F.col("strip").alias("to"), F.explode("edges.other").alias("id")).repartition("id").distinct()
        others = asked.join(dealt, "id").where(F.col("strip") != F.col("to")).select(F.col("to").alias("strip"), *[F.col(c).alias(c) for c in ("id", "x", "y")])
        run = strip_epochs(anchors, r * epochs, epochs, rounds * epochs, seed)
        y = staged(held.groupBy("strip").cogroup(others.groupBy("strip")).applyInArrow(run, "id long, x double, y double"), "places")
    return y.select(F.col("id").alias(row_id), "x", "y")
