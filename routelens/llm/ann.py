"""Approximate nearest neighbours on shifted space-filling curves.

Vectors are projected to a few dimensions by several random rotations of their principal axes, shifted
and laid out along a Hilbert curve each.  Spark range-partitions every curve's keys, which gives each
vector its rank on the curve; ranks are cut into blocks, and a query's candidates are the vectors of
the blocks around its own on any curve.  Candidates of all curves merge and are ranked by their exact
distances on the original vectors.

How many blocks to look at is measured, not guessed: for a bounded sample of queries the exact
neighbours are found by brute force, and the window is the smallest that holds the wanted share of
them on some curve.  Clustered vectors need a block or two; the flatter their spectrum, the wider the
window, up to all blocks, so recall is kept at every size.

Identical vectors are one point of the index (a hot vector is one row), and are told apart by vec_id
at the end only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routelens.llm.common import small_side
from routelens.llm.hilbert import hilbert_keys
from routelens.session import materialize

#: Curves, dimensions and bits of each, vectors of a block, vectors the axes are fitted on, axes kept.
CURVES = 6
DIMENSIONS, BITS = 9, 7
BLOCK = 512
SAMPLE = 4096
AXES = 32
#: Queries whose neighbours are found by brute force, and the share of these the window must hold.
PROBES = 64
#: Finds that a task holds before it sends them on.
HELD = 500_000
TARGET = 0.97


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


class Curves:
    """The projections of all curves, fitted on a sample."""

    def __init__(self, sample: np.ndarray, curves: int = CURVES, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean = sample.mean(axis=0)
        _, _, axes = np.linalg.svd(sample - self.mean, full_matrices=False)
        axes = axes[:AXES]
        dims = min(DIMENSIONS, len(axes))
        self.maps, self.low, self.span, self.shift = [], [], [], []
        for t in range(curves):
            turn = np.linalg.qr(rng.normal(size=(len(axes), len(axes))))[0][:, :dims] if t else np.eye(len(axes))[:, :dims]
            m = axes.T @ turn
            p = (sample - self.mean) @ m
            self.maps.append(m)
            self.low.append(p.min(axis=0))
            self.span.append(np.maximum(np.ptp(p, axis=0), 1e-12))
            self.shift.append(rng.random(dims))

    def keys(self, x: np.ndarray, curve: int) -> np.ndarray:
        """Keys on one curve: the sample's range fills half of the cube, moved by the curve's shift."""
        p = ((x - self.mean) @ self.maps[curve] - self.low[curve]) / self.span[curve]
        cells = np.clip((p + self.shift[curve]) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
        return hilbert_keys(cells, BITS)


def nearest(queries: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query the k nearest rows of ``x`` and all that tie with the last: (query, ids, exact distances)."""
    norms = (x ** 2).sum(axis=1)
    near = (queries ** 2).sum(axis=1)[:, None] + norms - 2 * queries @ x.T
    for q in range(len(queries)):
        d = near[q]
        if len(d) > k:
            # the expansion loses digits; take a little more, then measure exactly
            d = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1] + 1e-9 * (1 + norms.max()))
        else:
            d = np.arange(len(d))
        exact = np.sqrt(((queries[q] - x[d]) ** 2).sum(axis=1))
        order = np.lexsort((ids[d], exact))[:k]
        yield q, ids[d][order], exact[order]


def clean_vectors(table: DataFrame) -> tuple[DataFrame, int]:
    """vec_id and vec of the rows that take part, and their dimension: no null ids, no vectors that are
    null, zero, or hold null or non-finite components, or differ in length from the commonest."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = (table.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(fine & F.exists(v, lambda x: x != 0))
            .select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vec")))
    sizes = rows.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = sizes["dim"] if sizes else 0
    return rows.where(F.size("vec") == dim).distinct(), dim


def curve_blocks(points: DataFrame, curves: Curves, dim: int, block: int) -> DataFrame:
    """(cls, curve, block) for every point (cls, vec) on every curve: its rank divided by ``block``."""
    n_curves = len(curves.maps)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), dim)
            for t in range(n_curves):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(curves.keys(x, t)),
                                                  b.column(0)], ["curve", "key", "cls"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        pid, counts = TaskContext.get().partitionId(), np.zeros(n_curves, dtype=np.int64)
        for b in batches:  # rows come in the order of curves and keys
            curve = b.column(0).to_numpy()
            place = np.zeros(len(curve), dtype=np.int64)
            for t in np.unique(curve).tolist():
                here = curve == t
                place[here] = counts[t] + np.arange(int(here.sum()))
                counts[t] += int(here.sum())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.full(len(curve), pid, np.int32)),
                                              pa.array(place)], ["curve", "cls", "pid", "place"])

    partitions = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(
        points.select("cls", "vec").mapInArrow(keyed, "curve int, key long, cls long")
        .repartitionByRange(partitions, "curve", "key", "cls").sortWithinPartitions("curve", "key", "cls")
        .mapInArrow(numbered, "curve int, cls long, pid int, place long"), "ann-ranks")
    before = Window.partitionBy("c0").orderBy("p0").rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.groupBy(F.col("curve").alias("c0"), F.col("pid").alias("p0")).agg(F.count(F.lit(1)).alias("n"))
              .withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    return materialize(
        rows.join(F.broadcast(starts), (F.col("curve") == F.col("c0")) & (F.col("pid") == F.col("p0")))  # a row per partition and curve
        .select("cls", "curve", F.floor((F.col("start") + F.col("place")) / block).alias("block")), "ann-blocks")


def exact_neighbours(points: DataFrame, queries: list, dim: int, k: int) -> list:
    """Brute force for a bounded list of query rows (cls, vec): rows (q, cls) of their k nearest others."""
    q_ids = np.array([r["cls"] for r in queries], dtype=np.int64)
    q = np.array([r["vec"] for r in queries], dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(q_ids[i], c, d) for i, ids, ds in nearest(q, b.column(0).to_numpy(), matrix(b.column(1), dim), k + 1)
                   for c, d in zip(ids.tolist(), ds.tolist(), strict=True) if c != q_ids[i]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["q", "cls", "d"])

    top = Window.partitionBy("q").orderBy("d", "cls")
    return (points.select("cls", "vec").mapInArrow(run, "q long, cls long, d double")
            .withColumn("r", F.row_number().over(top)).where(F.col("r") <= k).select("q", "cls").collect())


def measured_window(blocks: DataFrame, neighbours: list, target: float) -> int:
    """The least number of blocks to either side that holds ``target`` of the neighbours on some curve."""
    if not neighbours:
        return 0
    wanted = sorted({x for r in neighbours for x in (r["q"], r["cls"])})
    at = {(r["cls"], r["curve"]): r["block"] for r in blocks.where(F.col("cls").isin(wanted)).collect()}
    curves = {c for _, c in at}
    gaps = sorted(min(abs(at[r["q"], c] - at[r["cls"], c]) for c in curves) for r in neighbours)
    return int(gaps[min(len(gaps) - 1, int(np.ceil(target * len(gaps))) - 1)])


def merged(q: np.ndarray, cls: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest distinct finds of each query, in order."""
    order = np.lexsort((cls, d, q))
    q, cls, d = q[order], cls[order], d[order]
    new = np.ones(len(q), dtype=bool)
    new[1:] = (q[1:] != q[:-1]) | (cls[1:] != cls[:-1])
    q, cls, d = q[new], cls[new], d[new]
    starts = np.flatnonzero(np.diff(q, prepend=q[:1] - 1))
    place = np.arange(len(q)) - np.repeat(starts, np.diff([*starts, len(q)]))
    return q[place < k], cls[place < k], d[place < k]


def _search(dim: int, k: int):
    """Over rows sorted by (curve, block, role): queries (role 0) of a block against its points (role 1).
    A task merges what its blocks find for a query before it sends anything on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, q_ids, q, p_ids, p = None, [], [], [], []
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]

        def send() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["q", "cls", "d"])
            held[:] = [x[:0] for x in held]
            return out

        def found() -> None:
            if not sum(map(len, q_ids)) or not sum(map(len, p_ids)):
                return
            qi, qx, pi, px = np.concatenate(q_ids), np.concatenate(q), np.concatenate(p_ids), np.concatenate(p)
            out: list[tuple] = []
            for a in range(0, len(qi), 1024):
                for i, ids, ds in nearest(qx[a:a + 1024], pi, px, k + 1):
                    out += [(qi[a + i], c, d) for c, d in zip(ids.tolist(), ds.tolist(), strict=True)]
            new = [np.array(x) for x in zip(*out, strict=True)]
            held[:] = merged(*[np.concatenate(x) for x in zip(held, new, strict=True)], k + 1)

        for b in batches:
            curve, block, role, ids = (b.column(i).to_numpy() for i in range(4))
            x = matrix(b.column(4), dim)
            cuts = np.flatnonzero((np.diff(curve) != 0) | (np.diff(block) != 0)) + 1
            for a, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(curve)], strict=True):
                if a == e:
                    continue
                if (curve[a], block[a]) != group:
                    found()
                    if len(held[0]) > HELD:
                        yield send()
                    group, q_ids, q, p_ids, p = (curve[a], block[a]), [], [], [], []
                asks = role[a:e] == 0
                q_ids.append(ids[a:e][asks])
                q.append(x[a:e][asks])
                p_ids.append(ids[a:e][~asks])
                p.append(x[a:e][~asks])
        found()
        if len(held[0]):
            yield send()

    return run


def knn(table: DataFrame, is_query, k: int = 10, curves: int = CURVES, block: int = BLOCK, target: float = TARGET) -> DataFrame:
    """The ``k`` nearest found of every row for which ``is_query`` (a condition on vec_id) holds:
    query_id, rank (from 1), vec_id, score (Euclidean distance in double precision).

    ``table`` has vec_id, embedding and any other columns; rows that take no part are those named in
    :func:`clean_vectors`.  A row that repeats id and vector counts once; ties go to the smaller
    vec_id; a query is never its own neighbour; with fewer candidates all are returned; an empty table
    gives no rows.
    """
    spark = table.sparkSession
    rows, dim = clean_vectors(table)
    schema = "query_id long, rank int, vec_id long, score double"
    if not dim:
        return spark.createDataFrame([], schema)
    rows = materialize(rows, "ann-rows")
    by_vector = Window.partitionBy("vec").orderBy("vec_id")
    # the k + 1 smallest ids of each distinct vector; Spark limits the groups before it shuffles them
    members = materialize(rows.withColumn("r", F.row_number().over(by_vector)).withColumn("cls", F.first("vec_id").over(by_vector))
                          .where(F.col("r") <= k + 1), "ann-members")
    points = members.where("r = 1").select("cls", "vec")
    asked = rows.where(is_query).select("vec_id", F.col("vec").alias("v0"))
    queries = materialize(points.join(small_side(asked, 8 + 4 * dim), F.col("vec") == F.col("v0"))
                          .select(F.col("vec_id").alias("query_id"), "cls", "vec"), "ann-queries")
    asking = queries.select("cls", "vec").dropDuplicates(["cls"])
    total = points.count()
    if not total:
        return spark.createDataFrame([], schema)
    share = int(min(1.0, SAMPLE / total) * (1 << 20)) + 1
    sample = points.where(F.pmod(F.xxhash64(F.lit(3), "cls"), F.lit(1 << 20)) < share).orderBy("cls").select("vec").collect()
    fitted = np.array([r["vec"] for r in sample[:2 * SAMPLE]], dtype=np.float64)
    if len(fitted) < 2:
        fitted = np.vstack([np.zeros(dim), np.ones(dim)])
    blocks = curve_blocks(points, Curves(fitted, curves), dim, block)
    probes = asking.orderBy(F.xxhash64(F.lit(5), "cls"), "cls").limit(PROBES).collect()
    window = measured_window(blocks, exact_neighbours(points, probes, dim, k), target) if probes else 0

    b = blocks.select(F.col("cls").alias("c0"), "curve", "block")
    data = points.join(b, F.col("cls") == F.col("c0")).select("curve", "block", F.lit(1).alias("role"), "cls", "vec")
    around = F.explode(F.sequence(F.col("block") - window, F.col("block") + window))
    asks = (asking.join(b, F.col("cls") == F.col("c0"))
            .select("curve", around.alias("block"), F.lit(0).alias("role"), "cls", "vec").where("block >= 0"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = (asks.unionByName(data).repartition(partitions, "curve", "block")
             .sortWithinPartitions("curve", "block", "role").mapInArrow(_search(dim, k), "q long, cls long, d double"))
    # a query's finds: at most k + 1 from each task, perhaps the same from several
    top = Window.partitionBy("q").orderBy("d", "cls")
    near = (pairs.groupBy("q", "cls").agg(F.min("d").alias("d"))
            .withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1).select("q", F.col("cls").alias("c1"), "d"))
    best = (near.join(members.select("cls", "vec_id"), F.col("c1") == F.col("cls"))
            .withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "vec_id")))
            .where(F.col("r") <= k + 1).select("q", "vec_id", "d"))
    best = small_side(materialize(best, "ann-best"), 32)
    order = Window.partitionBy("query_id").orderBy("d", "vec_id")
    return (queries.select("query_id", F.col("cls").alias("own")).join(best, F.col("own") == F.col("q"))
            .where("vec_id <> query_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("d").alias("score")))


def every_hundredth(table: DataFrame) -> DataFrame:
    return knn(table, F.col("vec_id") % 100 == 0)
