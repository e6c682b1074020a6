"""Clustering against plain whole-number k-means over all vectors."""

import hashlib
import math

import numpy as np

from routelens.llm import centroids as C


def plain(rows, k=16, rounds=3, dim=64, scale=64):
    kept = [(i, [math.floor(scale * float(c)) for c in v]) for i, v in rows
            if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [r[1] for r in order[:k]]

    def assign():
        out = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centres]
            out.append((i, d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        found = assign()
        for c in range(len(centres)):
            members = [v for (_, v), (_, x, _) in zip(kept, found, strict=True) if x == c]
            if members:
                centres[c] = [sum(col) // len(members) for col in zip(*members, strict=True)]
    return assign(), centres


def check(spark, rows, dim=64, **how):
    df = spark.createDataFrame([(i, v, 0, "y") for i, v in rows], "vec_id long, embedding array<float>, cluster int, x string").repartition(3)
    got, centres = C.clusters(df, dim=dim, **how)
    want, plain_centres = plain([(i, None if v is None else [None if c is None else np.float32(c) for c in v]) for i, v in rows], dim=dim,
                                **{a: b for a, b in how.items() if a != "block"})
    assert centres == plain_centres
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_clusters_equal_plain_rounds(spark):
    rng = np.random.default_rng(1)
    check(spark, [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 8)) * 0.3)], dim=8, k=5, block=64)


def test_copies_and_empty_clusters(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [0.5, -0.25, 0.125, 1.0]) for i in range(300)] + [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 4)), 300)]
    check(spark, rows, dim=4, k=16, block=128)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, 0.2]), (1, [0.1, 0.2]), (1, [0.3, -0.2]), (None, [1.0, 1.0]), (2, None), (3, [1.0]), (4, [nan, 0.0]), (5, [inf, 0.0]),
            (6, [None, 1.0]), (7, [-0.001, 1e4]), (8, [0.0, 0.0]), (9, [])]
    check(spark, rows, dim=2, k=3)
    check(spark, rows, dim=2, k=16)


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert C.cluster_digest(df).collect() == []
    assert C.cluster_digest(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).count() == 0


def test_widths_follow_the_data():
    rng = np.random.default_rng(3)
    few = rng.integers(0, 3, size=(2000, 8)).astype(np.int32)
    many = rng.integers(0, 100_000, size=(2000, 8)).astype(np.int32)
    copies = np.repeat(many[:5], 400, axis=0)
    assert C.dictionaries(copies)[0] == 8
    assert 1 < C.dictionaries(few)[0] < 8
    for x in (few, many, copies):
        width, cuts = C.dictionaries(x)
        assert (np.hstack([d[c] for d, c in cuts]) == x).all()
        centres = x[:4].astype(np.int64)
        cluster, d = C.nearest([w.astype(np.int64) for w, _ in cuts], np.stack([c for _, c in cuts]), centres)
        exact = ((x[:, None, :].astype(np.int64) - centres[None]) ** 2).sum(axis=2)
        assert (cluster == exact.argmin(axis=1)).all() and (d == exact.min(axis=1)).all()
