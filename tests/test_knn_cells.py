"""Pruned nearest-neighbour search: exact on every metric, and most cells are skipped on clustered vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from routelens.operators import knn as K


def brute(q, x, k, metric):
    out = []
    for v in q:
        if metric == "cosine":
            n = np.sqrt((x * x).sum(axis=1)) * np.sqrt((v * v).sum())
            s = np.where(n > 0, (x @ v) / np.where(n > 0, n, 1.0), 0.0)
        elif metric == "euclidean":
            s = -np.sqrt(((x - v) ** 2).sum(axis=1))
        else:
            s = -np.abs(x - v).sum(axis=1)
        s = np.round(s, 9)
        out.append(sorted(range(len(x)), key=lambda i: (-s[i], i))[:k])
    return out


def vectors(kind, n, dim, seed):
    rng = np.random.default_rng(seed)
    if kind == "uniform":
        x = rng.normal(size=(n, dim))
        return x / np.linalg.norm(x, axis=1)[:, None]
    centres = rng.normal(size=(25, dim))
    x = centres[rng.integers(0, 25, n)] + 0.03 * rng.normal(size=(n, dim))
    x[:30] = x[0]                                    # copies: ties by id
    x[30:33] = 0.0
    return x


@pytest.mark.parametrize("metric", K.METRICS)
@pytest.mark.parametrize("kind", ["uniform", "clustered"])
def test_cells_are_exact_and_skipped(metric, kind):
    x, q = vectors(kind, 2000, 8, 1), vectors(kind, 60, 8, 1)
    points = K.space(x, metric)
    pivots = K.choose_pivots(points, 40, metric)
    cells = K.Cells(metric, np.arange(len(x)), x, K.distances(points, pivots, metric).argmin(axis=1))
    i, row, sim = cells.nearest(q, 7, np.full(len(q), -np.inf))
    assert [row[i == a].tolist() for a in range(len(q))] == brute(q, x, 7, metric)
    if kind == "clustered":
        assert cells.visited < 0.5 * cells.pairs


def test_floors_only_leave_out_what_lies_below():
    x = vectors("uniform", 500, 6, 3)
    cells = K.Cells("cosine", np.arange(500), x, np.arange(500) % 9)
    i, row, sim = cells.nearest(x[:20], 10, np.full(20, -np.inf))
    floor = sim.reshape(20, 10)[:, 4]
    j, above, s = cells.nearest(x[:20], 10, floor)
    assert [above[j == a].tolist()[:5] for a in range(20)] == [row[i == a].tolist()[:5] for a in range(20)]
    assert (s >= floor[j]).all()


@pytest.mark.parametrize("metric", K.METRICS)
@pytest.mark.parametrize("kind", ["uniform", "clustered"])
def test_search_over_many_shards(spark, metric, kind):
    x = vectors(kind, 900, 8, 4)
    rows = [(f"t{i:04d}", "g" if i % 10 else "h", v.tolist()) for i, v in enumerate(x)]
    t = spark.createDataFrame(rows, "sample_id string, grp0 string, embedding array<double>")
    q = t.where(F.substring("sample_id", -1, 1) == "3").withColumn("sample_id", F.concat(F.lit("q"), "sample_id"))
    got = {}
    for r in K.knn_topk(q, t, 5, ["grp0"], metric=metric, shard_rows=100, cell_rows=10).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.neighbor_id
    own = [i for i in range(900) if i % 10]
    asked = [i for i in range(900) if i % 10 == 3]
    want = brute(x[asked], x[own], 5, metric)
    assert got == {f"qt{i:04d}": {n + 1: f"t{own[w]:04d}" for n, w in enumerate(ws)} for i, ws in zip(asked, want, strict=True)}


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    t = spark.createDataFrame([(1, "g", [1.0, 0.0]), (2, "g", [nan, 0.0]), (3, "g", [inf, 0.0]), (4, None, [1.0, 0.0]), (5, "g", None),
                               (6, "other", [1.0, 0.0])], "sample_id long, g string, embedding array<double>")
    q = spark.createDataFrame([(10, "g", [1.0, 0.1]), (11, "g", [nan, 1.0]), (12, None, [1.0, 0.0]), (13, "absent", [1.0, 0.0])],
                              "sample_id long, g string, embedding array<double>")
    got = K.knn_topk(q, t, 3, ["g"]).collect()
    assert [(r.query_id, r.neighbor_id, r["rank"]) for r in got] == [(10, 1, 1)]
    assert K.knn_topk(q.limit(0), t, 3, ["g"]).count() == 0
    assert K.knn_topk(q, t.limit(0), 3, ["g"]).count() == 0
