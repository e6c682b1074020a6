"""Single-precision values raise a query's need: doubles measure the few rows that may be among its first k."""

import numpy as np
import pytest

from routelens.operators import knn as K
from tests.test_knn_cells import brute, vectors


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_doubles_measure_few_rows_a_query(metric, monkeypatch):
    x, q = vectors("uniform", 6000, 16, 1), vectors("uniform", 300, 16, 2)
    cells, measured = K.Cells(metric, np.arange(len(x)), x, np.arange(len(x)) % 30), []
    exact = K.Cells.exact
    monkeypatch.setattr(K.Cells, "exact", lambda self, q, i, j: measured.append(len(i)) or exact(self, q, i, j))
    i, row, _ = cells.nearest(q, 10, np.full(len(q), -np.inf))
    assert [row[i == a].tolist() for a in range(len(q))] == brute(q, x, 10, metric)
    assert sum(measured) < 2 * 10 * len(q)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("scale", [1.0, 1e20])
def test_more_copies_than_values_can_tell_apart(metric, scale):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 8)) * scale
    x[500:3500] = x[0]
    x[3500:3600] = 0.0
    tids = rng.permutation(len(x))
    cells = K.Cells(metric, tids, x, np.arange(len(x)) % 7)
    q = x[[0, 1, 2, 700, 3550]]
    i, row, _ = cells.nearest(q, 10, np.full(len(q), -np.inf))
    order = np.argsort(tids)
    want = brute(q, x[order], 10, metric)
    assert [tids[row[i == a]].tolist() for a in range(len(q))] == want
