"""Hard negatives against brute force, on uniform, clustered and odd vectors."""

import math

import numpy as np
from pyspark.sql import functions as F

from routelens.llm import hard_negatives as H


def plain(rows, positives=5, negatives=10, every=100, scale=256):
    """rows: [(id, vector, label)], labels as they are after any change."""
    kept = sorted({(i, tuple(math.floor(scale * float(np.float32(c))) for c in v), y) for i, v, y in rows})
    x = np.array([r[1] for r in kept], dtype=np.int64)
    out = []
    for a, (i, q, y) in enumerate(kept):
        if i % every:
            continue
        s = (x @ np.array(q)).tolist()
        order = sorted(range(len(kept)), key=lambda r: (-s[r], kept[r][0]))
        for p in [r for r in order if kept[r][2] == y and r != a][:positives]:
            fit = [r for r in order if kept[r][2] != y and 30 * s[p] <= 100 * s[r] <= 90 * s[p]][:negatives]
            out += [(i, kept[p][0], n + 1, kept[r][0], s[p], s[r]) for n, r in enumerate(fit)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "z", 5) for i, v, y in rows], "vec_id long, embedding array<float>, label int, cls string, x int").repartition(3)


def check(spark, rows, **how):
    got = H.mined(frame(spark, rows), F.col("vec_id") % 100 == 0, **how)
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_uniform_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 12))
    x /= np.linalg.norm(x, axis=1)[:, None]
    check(spark, [(i, v.tolist(), int(rng.integers(0, 5))) for i, v in enumerate(x)], shard_rows=200, cell_rows=8)


def test_clusters_and_hot_vector(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 10))
    x = centres[rng.integers(0, 12, 900)] + 0.05 * rng.normal(size=(900, 10))
    rows = [(i, v.tolist(), int(rng.integers(0, 3))) for i, v in enumerate(x)]
    rows += [(i, centres[0].tolist(), i % 2) for i in range(900, 1400)]
    check(spark, rows, shard_rows=150, cell_rows=10)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.5], 1), (1, [0.9, 0.5], 1), (2, [0.5, 0.2], 2), (3, [0.5, 0.2], 2), (3, [0.5, 0.2], 2), (0, [-1.0, 0.3], 1),
            (100, [0.0, 0.0], 1), (200, [-0.7, -0.7], 2), (300, [0.4, 0.4], 7), (5, [0.5, 0.1], 3)]
    bad = [(400, [1.0, 1.0], None), (500, None, 1), (600, [1.0, None], 1), (700, [nan, 1.0], 1), (800, [inf, 1.0], 1), (None, [1.0, 1.0], 1),
           (900, [1.0], 1), (1000, [], 1)]
    got = H.mined(frame(spark, good + bad), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == plain(good)
    assert H.every_hundredth(frame(spark, good).limit(0)).count() == 0
    assert H.every_hundredth(frame(spark, bad).where("vec_id = 500")).count() == 0
    check(spark, [(i, [1.0, 0.5], 1) for i in range(5)])
    check(spark, [(i, [1.0], i % 2) for i in range(300)])


def shard_of(rng, x, words):
    books = (H.codebook(x[:, :4], words), H.codebook(x[:, 4:], words))
    n = len(x)
    return H.Shard(np.arange(n), np.arange(n), rng.integers(0, 4, n), H.coded(x[:, :4], books[0]), H.coded(x[:, 4:], books[1]), x, books)


def test_heap_stops_early_on_clusters_and_stays_exact():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 8))
    for x, share in ((np.floor(256 * (centres[rng.integers(0, 20, 2000)] + 0.02 * rng.normal(size=(2000, 8)))), 0.5),
                     (np.floor(256 * rng.normal(size=(2000, 8))), 0.0)):
        shard = shard_of(rng, x, 20)
        for a in range(0, 2000, 50):
            q, y = shard.x[a], int(shard.label[a])
            s = (shard.x @ q).astype(np.int64)
            want = sorted(np.flatnonzero(shard.label == y).tolist(), key=lambda r: (-s[r], shard.first[r]))[:6]
            rows, scores = shard.visit(q, y, True, [(H.NONE, -H.NONE)], [H.NONE], 6)[0]
            assert rows.tolist() == want and scores.tolist() == s[want].tolist()
        assert shard.skipped >= share * 40 * 2000
        q, y = shard.x[0], int(shard.label[0])
        s, (lo, hi) = (shard.x @ q).astype(np.int64), H.window(int((shard.x[0] @ shard.x[0])))
        want = sorted(np.flatnonzero((shard.label != y) & (s >= lo) & (s <= hi)).tolist(), key=lambda r: (-s[r], shard.first[r]))[:10]
        assert shard.visit(q, y, False, [(lo, hi)], [H.NONE], 10)[0][0].tolist() == want


def test_windows_by_whole_numbers():
    for mark in range(-50, 200):
        lo, hi = H.window(mark)
        assert [s for s in range(-100, 300) if 30 * mark <= 100 * s <= 90 * mark] == list(range(lo, hi + 1))
