"""Centroid clustering (k-means rounds in whole numbers) over subvector dictionaries.

Vectors are quantised to integers and written once as blocks of some thousand vectors.  A block cuts its
vectors into subvectors of a few dimensions and stores, per cut, the distinct subvectors and each
vector's code: a lossless dictionary encoding.  A round then works out, once per distinct subvector, its
exact squared distances to the centroids' parts, and a vector's distance is the sum of the entries that
its codes name.  The sums for new centroids come back the same way: code counts per cluster times the
dictionary.  How wide the cuts are is chosen block by block, from the distinct subvectors counted in it,
so that a round costs least; copies of whole vectors (a hot vector) shrink to one entry of the widest cut.

A round sends one row per cluster and task to the driver's side, whatever the table's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelens.llm.common import batch_rows
from routelens.session import materialize

CLUSTERS, ROUNDS, DIM, SCALE = 16, 3, 64, 64
#: Vectors of a block, and blocks that travel to Python at once.
BLOCK, BLOCKS_AT_ONCE = 4096, 16
#: Largest component, in absolute value, for which 64-bit distances are exact.
LARGEST = 1 << 27
#: What looking up one code costs, in multiplications.
LOOKUP = 2.0


def distinct_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of ``x`` and each row's number among them."""
    if x.shape[1] == 1:
        values, codes = np.unique(x[:, 0], return_inverse=True)
        return values[:, None], codes.ravel()
    raw = np.ascontiguousarray(x).view([("", x.dtype)] * x.shape[1]).ravel()
    _, first, codes = np.unique(raw, return_index=True, return_inverse=True)
    return x[first], codes.ravel()


def dictionaries(x: np.ndarray) -> tuple[int, list[tuple[np.ndarray, np.ndarray]]]:
    """(width, per cut (distinct subvectors, codes)) of the width at which a round costs least."""
    n, dim = x.shape
    best: tuple | None = None
    for width in [w for w in (1, 2, 4, 8, dim) if dim % w == 0]:
        cuts = [distinct_rows(x[:, a:a + width]) for a in range(0, dim, width)]
        cost = sum(len(d) * width for d, _ in cuts) + LOOKUP * n * len(cuts)
        if best is None or cost < best[0]:
            best = (cost, width, cuts)
    return best[1], best[2]


def _small(a: np.ndarray) -> np.ndarray:
    """``a`` in the narrowest signed integers that hold it."""
    most = int(np.abs(a).max(initial=0))
    return a.astype("<i1" if most < 1 << 7 else "<i2" if most < 1 << 15 else "<i4")


def _encode(dim: int, block: int):
    """Over (vec_id, x): a row per block of vectors: ids, width, dictionary sizes, dictionaries, codes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts = [], []

        def out() -> pa.RecordBatch:
            x = np.concatenate(parts)
            width, cuts = dictionaries(x)
            words = _small(np.concatenate([d.ravel() for d, _ in cuts]))
            codes = _small(np.stack([c for _, c in cuts]))
            return pa.RecordBatch.from_arrays(
                [pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(pa.int64())), pa.array([width], pa.int32()),
                 pa.array([[len(d) for d, _ in cuts]], pa.list_(pa.int32())), pa.array([words.dtype.itemsize], pa.int32()),
                 pa.array([words.tobytes()], pa.binary()), pa.array([codes.dtype.itemsize], pa.int32()),
                 pa.array([codes.tobytes()], pa.binary())],
                ["ids", "width", "sizes", "word_bytes", "words", "code_bytes", "codes"])

        for b in batches:
            for at in range(0, b.num_rows, block):
                part = b.slice(at, block)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                if np.abs(x).max(initial=0) > LARGEST:
                    raise ValueError(f"a quantised component lies beyond {LARGEST}: 64-bit distances would not be exact")
                ids.append(part.column(0))
                parts.append(x.astype(np.int32))
                if sum(map(len, parts)) >= block:
                    yield out()
                    ids, parts = [], []
        if parts:
            yield out()
    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray], np.ndarray]]:
    """Per block: ids, its dictionaries, its codes (cuts x vectors)."""
    for b in batches:
        for r in b.to_pylist():
            words = np.frombuffer(r["words"], f"<i{r['word_bytes']}").astype(np.int64)
            ends = np.cumsum(np.array(r["sizes"], dtype=np.int64) * r["width"])
            cuts = [w.reshape(-1, r["width"]) for w in np.split(words, ends[:-1])]
            yield r["ids"], cuts, np.frombuffer(r["codes"], f"<i{r['code_bytes']}").reshape(len(cuts), -1).astype(np.int64)


def nearest(cuts: list[np.ndarray], codes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centroid (ties: the smaller number) and squared distance, from the
    distances of the distinct subvectors."""
    total, at = np.zeros((codes.shape[1], len(centroids)), dtype=np.int64), 0
    for d, code in zip(cuts, codes, strict=True):
        part = centroids[:, at:at + d.shape[1]]
        table = np.zeros((len(d), len(centroids)), dtype=np.int64)
        for j in range(d.shape[1]):
            table += (d[:, j:j + 1] - part[None, :, j]) ** 2
        total += table[code]
        at += d.shape[1]
    cluster = total.argmin(axis=1)
    return cluster, total[np.arange(len(cluster)), cluster]


def _sums(centroids: np.ndarray):
    """A row per cluster of the task: its vectors and their sum by component."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = centroids.shape
        n, s = np.zeros(k, dtype=np.int64), np.zeros((k, dim), dtype=np.int64)
        for _, cuts, codes in _blocks(batches):
            cluster, _ = nearest(cuts, codes, centroids)
            n += np.bincount(cluster, minlength=k)
            at = 0
            for d, code in zip(cuts, codes, strict=True):
                seen = np.bincount(cluster * len(d) + code, minlength=k * len(d)).reshape(k, len(d))
                s[:, at:at + d.shape[1]] += seen @ d
                at += d.shape[1]
        full = np.flatnonzero(n)
        if len(full):
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(n[full]), pa.array(s[full].tolist(), pa.list_(pa.int64()))],
                                             ["cluster", "n", "s"])
    return run


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, cuts, codes in _blocks(batches):
            cluster, d = nearest(cuts, codes, centroids)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cluster.astype(np.int32)), pa.array(d)],
                                             ["vec_id", "cluster", "distance"])
    return run


def quantised(table: DataFrame, scale: int, dim: int) -> DataFrame:
    """vec_id and x, the components as floor(scale * component), of the rows whose vector has exactly
    ``dim`` components, none null or non-finite."""
    v = F.col("embedding")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return (table.where(v.isNotNull() & (F.size(v) == dim)).where(fine)
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(c.cast("double") * scale)).alias("x")))


def start_order(vec_id: Column) -> Column:
    return F.sha2(F.concat(F.lit("1:"), vec_id.cast("string")), 256)


def clusters(table: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE,
             block: int = BLOCK) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) for every vector kept, and the final centroids.

    ``table`` has vec_id, embedding and any other columns; :func:`quantised` says which rows are kept.
    Starts are the ``k`` kept rows whose id comes first in :func:`start_order` (ties, as when an id
    repeats: the smaller vector; null ids last); with fewer rows there are fewer clusters.  Repeated rows
    are vectors of their own.  Empty clusters keep their centroid.  An empty table gives no rows.  A
    component beyond ``LARGEST`` after quantising fails the job, as distances would not be exact.
    """
    spark = table.sparkSession
    rows = quantised(table, scale, dim)
    blocks = materialize(
        rows.mapInArrow(_encode(dim, block), "ids array<long>, width int, sizes array<int>, word_bytes int, words binary, "
                                             "code_bytes int, codes binary"), "centroid-blocks")
    starts = rows.orderBy(start_order(F.col("vec_id")).asc_nulls_last(), "x").limit(k).select("x").collect()
    if not starts:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    centroids = [list(r["x"]) for r in starts]
    sums = [F.sum(F.col("s")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(dim)]
    with batch_rows(spark, BLOCKS_AT_ONCE):
        for _ in range(rounds):
            now = np.array(centroids, dtype=np.int64)
            found = blocks.mapInArrow(_sums(now), "cluster int, n long, s array<long>")
            for r in found.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():  # a row per cluster
                centroids[r["cluster"]] = [int(r[f"s{j}"]) // r["n"] for j in range(dim)]
        final = np.array(centroids, dtype=np.int64)
        assigned = materialize(blocks.mapInArrow(_assign(final), "vec_id long, cluster int, distance long"), "centroid-assigned")
    return assigned, centroids


def cluster_digest(table: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector kept."""
    spark = table.sparkSession
    assigned, centroids = clusters(table)
    names = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    totals = {r["cluster"]: int(r["d"]) for r in
              assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    of = spark.createDataFrame([(i, totals.get(i, 0), sum(totals.values()), sha) for i, sha in names],
                               "c0 int, cluster_inertia long, inertia long, centroid_sha256 string")
    return (assigned.join(F.broadcast(of), F.col("cluster") == F.col("c0"))  # a row per cluster
            .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))
