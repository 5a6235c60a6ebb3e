"""Comparisons at a tie don't hang on rounding that the definition doesn't have."""

from functools import reduce
from operator import add

from pulsemill.operators import fiducials, signals


def test_moving_means_are_those_of_their_frames(spark):
    v = [1e9, 0.1, 0.7, 0.3, 0.4, 0.6]
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(v)], "fin int, i int, v double")
    for width in (1, 3):
        half = width // 2
        frames = [v[max(0, i - half) : i + half + 1] for i in range(len(v))]
        got = [r.m for r in fiducials.moving_mean(rows, ["fin"], "v", width, "m").orderBy("i").collect()]
        assert got == [reduce(add, f, 0.0) / len(f) for f in frames]


def test_zero_crossings_do_not_hang_on_the_order_of_storage(spark):
    rows = [(1, 0, 0.1), (1, 1, 0.2), (1, 2, 0.3)]
    found = []
    for stored in (rows, rows[::-1]):
        df = spark.createDataFrame(stored, "fin int, t int, v double").coalesce(1)
        found.append([(r.t, r.direction) for r in signals.zero_crossings(df, ["fin"], ["t"], "v").collect()])
    assert found[0] == found[1] == [(1, "positive")]
