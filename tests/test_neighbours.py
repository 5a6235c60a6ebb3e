"""Neighbour graphs, memberships and layouts against brute force and planted groups."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from pulsemill.operators import modelling, neighbours


def exact(x, k):
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return d, np.argsort(d, 1, kind="stable")[:, :k]


def as_frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(4)


def test_neighbours_of_many_stretches(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "STRETCH", 64)
    monkeypatch.setattr(neighbours, "TASK_ROWS", 500)
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (1500, 12)) + 3 * rng.normal(0, 1, (8, 12))[rng.integers(0, 8, 1500)]
    d, near = exact(x, 10)
    rows = neighbours.neighbour_graph(as_frame(spark, x), "id", "v", 10).collect()
    assert len(rows) == 15_000 and all(r.distance == pytest.approx(d[r.id, r.other], abs=1e-9) for r in rows)
    found = {}
    for r in rows:
        found.setdefault(r.id, []).append((r.rank, r.other, r.distance))
    assert all([n for n, *_ in sorted(v)] == list(range(1, 11)) and sorted(z for *_, z in v) == [z for *_, z in sorted(v)] for v in found.values())
    recall = np.mean([len({o for _, o, _ in v} & set(near[i].tolist())) / 10 for i, v in found.items()])
    assert recall >= 0.95


def test_rounds_find_what_orders_miss(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "STRETCH", 16)
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (600, 6))
    _, near = exact(x, 8)
    recall = lambda rows: np.mean([r.other in near[r.id] for r in rows])
    before, after = (recall(neighbours.neighbour_graph(as_frame(spark, x), "id", "v", 8, orders=1, rounds=n).collect()) for n in (0, 8))
    assert before < 0.5 and after > 0.9


def shuffled_bytes(spark):
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_vectors_move_once_for_each_cell_visited(spark, monkeypatch):
    """Lists of neighbours with their vectors took 155 kB a row on the 10,256 vectors of check_s."""
    monkeypatch.setattr(neighbours, "CELL_ROWS", 400)
    monkeypatch.setattr(neighbours, "GUESTS", 500)
    x = np.random.default_rng(6).normal(0, 1, (2000, 64)).astype(np.float32)
    df = as_frame(spark, x).select("id", F.col("v").cast("array<float>").alias("v"))
    before = shuffled_bytes(spark)
    rows = neighbours.neighbour_graph(df, "id", "v", 15).collect()
    assert shuffled_bytes(spark) - before < 12_000 * 2000
    _, near = exact(x.astype(float), 15)
    assert len(rows) == 30_000 and np.mean([r.other == near[r.id, r.rank - 1] for r in rows]) == 1


def test_bytes_of_neighbours_grow_as_the_rows(spark):
    """With cells of 8,192 rows a row of the larger table was sent to five cells, in two rounds that each dealt the graph anew."""
    x = np.random.default_rng(8).normal(0, 1, (40_000, 16)).astype(np.float32)
    each = []
    for n in (8000, 40_000):
        df = spark.createDataFrame(pa.table({"id": pa.array(range(n), pa.int64()), "v": pa.FixedSizeListArray.from_arrays(x[:n].ravel(), 16).cast(pa.list_(pa.float32()))})).repartition(4)
        before = shuffled_bytes(spark)
        assert neighbours.neighbour_graph(df, "id", "v", 10, orders=2).count() == 10 * n
        each.append((shuffled_bytes(spark) - before) / n)
    assert each[1] < 1.15 * each[0]


@pytest.mark.parametrize(("spread", "off"), [(1, 0), (1, 1e9), (1e-22, 0), (1e80, 0)])
def test_chosen_rows_hold_the_nearest(spread, off):
    """Floats only choose: equal rows, far-off means and numbers beyond floats lose no neighbour, nor does a row without a distance hide others."""
    rng = np.random.default_rng(9)
    y = rng.normal(0, 1, (900, 7)) * spread + off
    y[100:140] = y[0]
    y[200, 3], y[201, 2] = np.nan, np.inf
    x = np.concatenate([y[:20], rng.normal(0, 1, (20, 7)) * spread + off])
    with np.errstate(invalid="ignore", over="ignore"):
        d = np.sqrt(((x[:, None] - y) ** 2).sum(2))
    d[:, 200:202] = np.inf
    within = neighbours.finder(y)
    for far in (np.full(40, np.inf), np.full(40, 1.5 * spread), np.zeros(40)):
        i, j, gap = within(x, far, 6)
        for row in range(40):
            wanted = set(np.flatnonzero((d[row] <= far[row]) & (d[row] <= np.sort(d[row])[5]) & (d[row] < np.inf)).tolist())
            assert wanted <= set(j[i == row].tolist())
        assert (gap == d[i, j]).all()


def test_cells_of_copies_are_cut(spark, monkeypatch):
    """Ties go to the least ids, also where copies fill several cells; nothing that a bound leaves out is nearer."""
    monkeypatch.setattr(neighbours, "STRETCH", 32)
    monkeypatch.setattr(neighbours, "CELL_ROWS", 60)
    rng = np.random.default_rng(7)
    x = np.concatenate([np.ones((200, 4)), rng.normal(0, 1, (200, 4)), rng.normal(9, 0.2, (150, 4))])
    d, near = exact(x, 6)
    rows = neighbours.neighbour_graph(as_frame(spark, x), "id", "v", 6, settled=0.0).collect()
    assert len(rows) == 550 * 6 and all(r.other == near[r.id, r.rank - 1] and r.distance == pytest.approx(d[r.id, r.other], abs=1e-9) for r in rows)


def test_equal_vectors_and_small_tables(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "STRETCH", 32)
    x = np.concatenate([np.zeros((150, 3)), np.random.default_rng(2).normal(5, 1, (90, 3))])
    rows = neighbours.neighbour_graph(as_frame(spark, x), "id", "v", 5).collect()
    assert len(rows) == 240 * 5 and all(r.distance == 0 and r.other < 150 for r in rows if r.id < 150)
    assert neighbours.neighbour_graph(as_frame(spark, x[:0]), "id", "v").count() == 0
    assert neighbours.neighbour_graph(as_frame(spark, x[:1]), "id", "v").count() == 0
    assert neighbours.neighbour_graph(as_frame(spark, x[148:152]), "id", "v").count() == 12


def test_memberships_add_up(spark):
    x = np.random.default_rng(3).normal(0, 1, (60, 4))
    d, near = exact(x, 8)
    a = np.zeros((60, 60))
    for i in range(60):
        z = d[i, near[i]] - d[i, near[i]].min()
        low, high = 1e-9, 1e3
        for _ in range(100):
            s = (low + high) / 2
            low, high = (low, s) if np.exp(-z / s).sum() > 3 else (s, high)
        a[i, near[i]] = np.exp(-z / s)
    wanted = a + a.T - a * a.T
    graph = spark.createDataFrame([(i, int(j), float(d[i, j])) for i in range(60) for j in near[i]], "id long, other long, distance double")
    rows = neighbours.memberships(graph).collect()
    assert len(rows) == (np.triu(wanted) > 0).sum() and all(r.u < r.v and r.w == pytest.approx(wanted[r.u, r.v], abs=1e-6) for r in rows)


@pytest.mark.parametrize("strip", [16_384, 100])
def test_layouts_keep_groups_together(spark, monkeypatch, strip):
    monkeypatch.setattr(neighbours, "STRIP_ROWS", strip)
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (5, 15))
    x = np.concatenate([centres[np.arange(300) % 5] + rng.normal(0, 0.25, (300, 15)), np.repeat(centres[:1], 20, 0)])
    out = neighbours.layout(as_frame(spark, x), "id", "v", 10, rounds=6).orderBy("id").collect()
    assert [r.id for r in out] == list(range(320))
    group = np.append(np.arange(300) % 5, np.zeros(20, int))
    _, near = exact(np.array([(r.x, r.y) for r in out]), 8)
    assert (group[near] == group[:, None]).mean() > 0.97
    assert len({(r.x, r.y) for r in out}) == 320


def test_layouts_of_few_rows_and_reducers(spark):
    x = np.random.default_rng(5).normal(0, 1, (40, 5))
    assert neighbours.layout(as_frame(spark, x[:0]), "id", "v").count() == 0
    assert neighbours.layout(as_frame(spark, x[:2]), "id", "v").count() == 2
    df = as_frame(spark, x).select("id", array_to_vector("v").alias("features"), F.lit("kept").alias("other"))
    for name, size in (("none", 5), ("pca", None), ("layout", 2), ("pca_layout", 2)):
        out = modelling.REDUCERS[name](df, "id")
        assert out.count() == 40 and set(out.columns) == {"id", "features", "other"} and (size is None or len(out.first().features) == size)
