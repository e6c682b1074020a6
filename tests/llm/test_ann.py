"""Nearest neighbours against brute force: recall on whole tables, exactness where windows cover all."""

import numpy as np
from pyspark.sql import functions as F

from routelens.llm import ann as A
from routelens.llm.hilbert import hilbert_keys
from routelens.sources.tables import read_table

SF001 = "/root/testdata/sf0.01"


def brute(rows, queries, k=10):
    """rows: [(id, vector)]; the k nearest others of each query id, by (distance, id)."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    out = {}
    for q in queries:
        i = int(np.flatnonzero(ids == q)[0])
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def as_lists(got):
    out = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_hilbert_curve_visits_neighbours():
    cells = np.array([(i, j, k) for i in range(8) for j in range(8) for k in range(8)])
    keys = hilbert_keys(cells, 3)
    walk = cells[np.argsort(keys)]
    assert sorted(keys.tolist()) == list(range(512))
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_query_recall(spark):
    from routelens.llm.queries import QUERIES
    rows = [(r["vec_id"], r["embedding"]) for r in read_table(spark, SF001, "embeddings").collect()]
    want = brute(rows, [i for i, _ in rows if i % 100 == 0])
    got = as_lists(QUERIES["op8_ann"](spark, SF001).collect())
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    true = {q: {i: d for i, d in brute(rows, [q], len(rows))[q]} for q in want}
    assert all(abs(true[q][i] - d) < 1e-12 for q in got for i, d in got[q])


def test_windows_keep_recall(spark):
    """Small blocks, so that windows don't cover the table."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    x = (centres[rng.integers(0, 30, 3000)] + 0.1 * rng.normal(size=(3000, 16))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute(rows, range(0, 3000, 100))
    got = as_lists(A.knn(df, F.col("vec_id") % 100 == 0, block=40).collect())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 300


def test_odd_rows(spark):
    """Copies of one vector (ties to the smaller id), vectors that take no part, repeats, few candidates."""
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(0, 40)] + [(100, [1.0, 2.5, 0.5]), (200, [9.0, 9.0, 9.0]), (100, [1.0, 2.5, 0.5])]
    bad = [(300, None), (400, [0.0, 0.0, 0.0]), (500, [1.0, nan, 0.0]), (600, [inf, 0.0, 1.0]), (700, [1.0, None, 2.0]),
           (800, [1.0]), (None, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + bad], "vec_id long, embedding array<float>, cls string, rank int")
    got = as_lists(A.every_hundredth(df).collect())
    want = brute(sorted({(i, tuple(v)) for i, v in rows}), [0, 100, 200])
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    few = as_lists(A.every_hundredth(df.where("vec_id in (100, 200)")).collect())
    assert {q: [i for i, _ in v] for q, v in few.items()} == {100: [200], 200: [100]}
    assert A.every_hundredth(df.limit(0)).count() == 0
    assert A.every_hundredth(df.where("vec_id = 200")).count() == 0
