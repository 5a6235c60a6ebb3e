"""Spectral clustering of labellings against the eigenvectors of the whole matrix."""

import numpy as np
import pytest

from pulsemill.operators import spectral


def planted(seed=0, n=120, models=8, wrong=0.15):
    rng = np.random.default_rng(seed)
    group = np.arange(n) % 3
    votes = np.stack([(group * 2 + b) % 5 for b in range(models)], 1)
    noise = rng.random(votes.shape) < wrong
    votes[noise] = rng.integers(0, 5, noise.sum())
    return group, votes


def test_embedding_is_that_of_the_whole_matrix(spark):
    _, votes = planted()
    labels = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(votes)], "id long, votes array<int>")
    placed, values = spectral.embedding(spectral.vote_groups(labels), 4)
    w = (votes[:, None, :] == votes[None, :, :]).mean(2)
    d = w.sum(1)
    value, vector = np.linalg.eigh(w / np.sqrt(d[:, None] * d))
    assert np.allclose(values, value[::-1][:4]) and values[0] == pytest.approx(1)
    wanted = vector[:, ::-1][:, :4] / np.sqrt(d)[:, None]
    of = {tuple(r.votes): np.array(r.u) for r in placed.collect()}
    got = np.array([of[tuple(v)] for v in votes.tolist()])
    for i in range(4):
        scale = got[:, i] @ wanted[:, i] / (wanted[:, i] @ wanted[:, i])
        assert np.allclose(got[:, i], scale * wanted[:, i], atol=1e-9)


def test_planted_groups_are_found_and_equal_votes_stay_together(spark):
    group, votes = planted(1, 150)
    rows = [(i, v.tolist()) for i, v in enumerate(votes)] + [(1000 + i, v.tolist()) for i, v in enumerate(votes[:30])]
    found = {r.id: r.cluster for r in spectral.spectral_clusters(spark.createDataFrame(rows, "id long, votes array<int>"), "id", 3).collect()}
    assert len(found) == 180 and all(found[1000 + i] == found[i] for i in range(30))
    pairs = {(found[i], g) for i, g in enumerate(group)}
    assert len(pairs) == 3


def test_rows_without_labels(spark):
    rows = [(i, [i % 2, None if i % 3 == 0 else i % 2, 1 - i % 2]) for i in range(20)] + [(99, [None, None, None])]
    found = {r.id: r.cluster for r in spectral.spectral_clusters(spark.createDataFrame(rows, "id long, votes array<int>"), "id", 2).collect()}
    assert len(found) == 21 and len({(found[i], i % 2) for i in range(20)}) == 2


def test_too_many_labels(spark, monkeypatch):
    monkeypatch.setattr(spectral, "MOST_CELLS", 3)
    rows = spark.createDataFrame([(i, [i, 0]) for i in range(5)], "id long, votes array<int>")
    with pytest.raises(ValueError):
        spectral.spectral_clusters(rows, "id", 2)
