"""Buckets of the neighbour search."""

import numpy as np
import pytest

from terncube.llm import neighbours


def test_rotations_as_one_product_and_in_steps(monkeypatch):
    x = np.random.default_rng(1).normal(size=(50, 12))
    hashes = neighbours.CrossPolytope(12, 6.0, 3, 4)
    dense = [hashes.scores(hashes.lift(x, True), t) for t in range(3)]
    monkeypatch.setattr(neighbours, "DENSE", 0)
    for (a, b), (c, d) in zip(dense, [hashes.scores(hashes.lift(x, True), t) for t in range(3)], strict=True):
        assert np.allclose(a, c) and np.allclose(b, d)


@pytest.mark.parametrize("n", [1, 5, 33, 500])
def test_probes_are_the_cheapest_pairs(n):
    x = np.random.default_rng(2).normal(size=(20, 12))
    hashes = neighbours.CrossPolytope(12, 6.0, 2, 4)
    got = hashes.probes(x, n)
    for t in range(2):
        a, b = hashes.scores(hashes.lift(x, True), t)
        loss = ((a.max(1, keepdims=True) - a) ** 2)[:, :, None] + ((b.max(1, keepdims=True) - b) ** 2)[:, None, :]
        loss = loss.reshape(20, -1)
        assert got.shape == (20, 2, min(n, loss.shape[1]))
        for row, found in zip(loss, got[:, t], strict=True):
            assert len(set(found)) == len(found) and np.isclose(row[found].max(), np.sort(row)[len(found) - 1])
