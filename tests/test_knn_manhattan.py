"""Sums of absolute differences: a product of matrices bounds them, few pairs are added up one by one."""

import numpy as np
import pytest

from routelens.operators import knn as K
from tests.test_knn_cells import brute, vectors


def test_few_pairs_are_added_up(monkeypatch):
    x, q = vectors("uniform", 6000, 16, 1), vectors("uniform", 300, 16, 2)
    cells, measured = K.Cells("manhattan", np.arange(len(x)), x, np.arange(len(x)) % 12), []
    exact = K.Cells.exact
    monkeypatch.setattr(K.Cells, "exact", lambda self, q, i, j: measured.append(len(i)) or exact(self, q, i, j))
    i, row, sim = cells.nearest(q, 10, np.full(len(q), -np.inf))
    assert [row[i == a].tolist() for a in range(len(q))] == brute(q, x, 10, "manhattan")
    assert sum(measured) < 2 * 10 * len(q)


@pytest.mark.parametrize("scale", [1e-30, 1.0, 1e12, 1e20])
@pytest.mark.parametrize("kind", ["spread", "steps", "constant"])
def test_bound_leaves_no_neighbour_out(kind, scale):
    rng = np.random.default_rng(7)
    x = {"spread": rng.standard_cauchy((3000, 9)), "steps": rng.integers(-2, 3, (3000, 9)).astype(float),
         "constant": np.column_stack([np.full((3000, 8), 0.25), rng.normal(size=3000)])}[kind] * scale
    q = x[rng.permutation(3000)[:200]] + (0.01 * scale * rng.normal(size=(200, 9)) if kind == "spread" else 0.0)
    cells = K.Cells("manhattan", np.arange(len(x)), x, np.arange(len(x)) % 7)
    i, row, sim = cells.nearest(q, 12, np.full(len(q), -np.inf))
    assert [row[i == a].tolist() for a in range(len(q))] == brute(q, x, 12, "manhattan")


def test_more_copies_than_values_can_tell_apart():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 8))
    x[500:3500] = x[0]
    x[3500:3600] = 0.0
    tids = rng.permutation(len(x))
    cells = K.Cells("manhattan", tids, x, np.arange(len(x)) % 3)
    q = np.concatenate([x[[0, 1, 2, 700, 3550]]] * 10)
    i, row, _ = cells.nearest(q, 10, np.full(len(q), -np.inf))
    order = np.argsort(tids)
    assert [tids[row[i == a]].tolist() for a in range(len(q))] == brute(q, x[order], 10, "manhattan")


def test_distances_of_blocks_are_sums_of_absolute_differences():
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(700, 5)), rng.normal(size=(300, 5))
    assert np.allclose(K.distances(a, b, "manhattan"), np.abs(a[:, None] - b[None]).sum(axis=2), rtol=1e-12, atol=0)
    assert K.distances(a[:0], b, "manhattan").shape == (0, 300) and K.distances(a, b[:0], "manhattan").shape == (700, 0)
