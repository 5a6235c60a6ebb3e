"""Peaks against going through the samples one by one."""

import numpy as np
import pytest

from pulsemill.operators import peaks


def brute(x, distance, height, least):
    n, found, i = len(x), [], 1
    while i < n - 1:
        j = i
        while j < n - 1 and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j < n - 1 and x[j + 1] < x[i]:
            found.append((i + j) // 2)
        i = j + 1
    found = [p for p in found if height is None or x[p] >= height]
    kept = []
    for p in sorted(found, key=lambda p: (x[p], p), reverse=True):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    out = []
    for p in sorted(kept):
        a = b = p
        while a > 0 and x[a - 1] <= x[p]:
            a -= 1
        while b < n - 1 and x[b + 1] <= x[p]:
            b += 1
        prominence = x[p] - max(min(x[a : p + 1]), min(x[p : b + 1]))
        level = x[p] - prominence / 2
        i = p
        while i > a and x[i] > level:
            i -= 1
        left = i + (level - x[i]) / (x[i + 1] - x[i]) if x[i] < level else i
        i = p
        while i < b and x[i] > level:
            i += 1
        right = i - (level - x[i]) / (x[i - 1] - x[i]) if x[i] < level else i
        if right - left >= least:
            out.append((p, prominence, right - left))
    return out


@pytest.mark.parametrize("seed", range(60))
def test_peaks_one_by_one(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 200))
    x = rng.integers(0, 6, n).astype(float) if seed % 2 else np.cumsum(rng.normal(0, 1, n))
    distance, height, least = float(rng.choice([1, 3, 7.5, 20])), rng.choice([None, 0.0, 3.0]), float(rng.choice([0, 1.5, 4]))
    at, prominence, width = peaks.peaks(x, distance, height, least)
    wanted = brute(x.tolist(), distance, height, least)
    assert at.tolist() == [w[0] for w in wanted]
    assert np.allclose(prominence, [w[1] for w in wanted]) and np.allclose(width, [w[2] for w in wanted])


def test_peaks_of_keys(spark):
    rng = np.random.default_rng(1)
    rows, wanted = [], set()
    for k in range(4):
        x = np.sin(np.arange(300) / (5 + k)) + 0.1 * rng.normal(0, 1, 300)
        rows += [(k, i, None if i % 50 == 7 else float(v)) for i, v in enumerate(x)]
        held = [(i, v) for i, v in enumerate(x) if i % 50 != 7]
        wanted |= {(k, held[p][0]) for p, *_ in brute([v for _, v in held], 10, 0.2, 2.0)[1:-1]}
    df = spark.createDataFrame(rows + [(9, 0, 1.0), (9, 1, None)], "k int, i int, v double").repartition(5)
    out = peaks.greedy_peaks(df, ["k"], 10, 0.2, 2.0, inner=True).collect()
    assert {(r.k, r.i) for r in out} == wanted and len(out) == len(wanted)
