"""Hard-negative mining over an inverted multi-index.

Vectors are cut into two halves; each half has a codebook, and a pair of codes is a cell.  Rows are
range-partitioned by cell into shards of some thousand rows, so a hot cell is many shards.  A row's
score (the inner product with an anchor) is at most the sum of two half bounds, each the half anchor
times a code word plus its length times the code's radius.  Inside a shard a heap walks pairs of codes in
the order of that sum (multi-sequence), scores the rows of each cell exactly, and stops as soon as the
next sum lies below what every window of the anchor still needs: the window is then certified.  Cells
that lie wholly above an anchor's windows are passed over.

An anchor first visits the shard of its own cell; what it finds there is the floor with which it is then
sent to those other shards alone that may hold a better row.  Results are exact whatever the codebooks,
which are fitted on a bounded sample and only decide how much is skipped.

Rows with the same vector and label are one point of the index, of which the few smallest ids are kept
(no list can need more); equal anchors are asked once.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routelens.llm.common import hash63, small_side
from routelens.session import materialize

POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of its positive's.
LOW, HIGH = 30, 90
SCALE = 256
#: Points the codebooks are fitted on, points aimed at per cell, code words of a half, rows of a shard.
SAMPLE, CELL_ROWS, MOST_WORDS, SHARD_ROWS = 4096, 64, 256, 8192
#: Rows scored at once (doubling from the first figure to the second), anchors that meet a shard in one task, rows of the shard directory in one task.
LEAST_STEP, STEP, ANCHORS, DIRECTORY = 64, 2048, 4096, 65536
#: Components beyond this, in absolute value, would not give exact 64-bit scores.
LARGEST = 1 << 28
NONE = -(1 << 62)


def codebook(x: np.ndarray, words: int, seed: int = 7, rounds: int = 8) -> np.ndarray:
    """At most ``words`` code words for the rows of ``x`` (plain k-means on the sample)."""
    x = np.unique(x, axis=0)
    if len(x) <= words:
        return x
    book = x[np.random.default_rng(seed).choice(len(x), words, replace=False)]
    for _ in range(rounds):
        code = coded(x, book)
        n = np.bincount(code, minlength=len(book))
        sums = np.zeros_like(book)
        np.add.at(sums, code, x)
        book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book)
    return book


def coded(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book ** 2).sum(axis=1) - 2 * x @ book.T).argmin(axis=1)


def window(mark: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """Least and largest negative score beside a positive score ``mark``."""
    return -((-low * mark) // 100), (high * mark) // 100


def slack(x: np.ndarray) -> float:
    """What rounding may take off a bound of scores against rows or anchors of this size."""
    return 1e-6 + 1e-9 * float(np.abs(x).max(initial=0.0)) ** 2 * x.shape[-1]


class Shard:
    """The rows of one shard, by cell, with the radius of every code in it."""

    def __init__(self, cls, first, label, i, j, x, books):
        order = np.lexsort((label, j, i))
        self.cls, self.first, self.label, self.x = cls[order], first[order], label[order], x[order]
        half = books[0].shape[1]
        self.halves, self.radius, codes = [], [], []
        for code, part, book in ((i[order], self.x[:, :half], books[0]), (j[order], self.x[:, half:], books[1])):
            used, at = np.unique(code, return_inverse=True)
            away = np.sqrt(((part - book[code]) ** 2).sum(axis=1))
            radius = np.zeros(len(used))
            np.maximum.at(radius, at, away)
            self.halves.append(book[used])
            self.radius.append(radius)
            codes.append(at)
        starts = np.flatnonzero(np.diff(codes[0] * len(self.halves[1]) + codes[1], prepend=-1))
        self.ends = np.append(starts, len(cls))
        self.cell = np.full((len(self.halves[0]), len(self.halves[1])), -1)
        self.cell[codes[0][starts], codes[1][starts]] = np.arange(len(starts))
        self.exact = np.abs(self.x).max(initial=0.0) ** 2 * self.x.shape[1] < 2 ** 52
        self.most = slack(self.x)
        self.skipped = 0  # rows that no anchor had to score

    def score(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.exact and np.abs(q).max(initial=0.0) ** 2 * len(q) < 2 ** 52:
            return (self.x[rows] @ q).astype(np.int64)
        return self.x[rows].astype(np.int64) @ q.astype(np.int64)

    def bounds(self, q: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        half = self.halves[0].shape[1]
        parts = (q[:half], q[half:])
        mid = [h @ p for h, p in zip(self.halves, parts, strict=True)]
        reach = [np.sqrt((p ** 2).sum()) * r for r, p in zip(self.radius, parts, strict=True)]
        return [m + r for m, r in zip(mid, reach, strict=True)], [m - r for m, r in zip(mid, reach, strict=True)]

    def visit(self, q: np.ndarray, label: int, same: bool, windows: list[tuple[int, int]], floors: list[int],
              k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per window the first ``k`` rows (score falling, then first id) with the anchor's label
        (``same``) or another: (rows, scores); rows below a window's floor may be left out."""
        need = [max(lo, f) for (lo, _), f in zip(windows, floors, strict=True)]
        high = max((hi for lo, hi in windows if lo <= hi), default=NONE)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
        open_ = [w for w, (lo, hi) in enumerate(windows) if lo <= hi]
        if not open_:
            return best
        up, down = self.bounds(q)
        eps = self.most + slack(q) + 1e-9 * sum(float(np.abs(u).max()) for u in up)
        by = [np.argsort(-u, kind="stable") for u in up]
        u0, u1, l0, l1 = up[0][by[0]], up[1][by[1]], down[0][by[0]], down[1][by[1]]
        pending: list[np.ndarray] = []

        def evaluate() -> None:
            rows = np.concatenate(pending)
            pending.clear()
            rows = rows[(self.label[rows] == label) == same]
            s = self.score(rows, q)
            for w in open_:
                fits = (s >= need[w]) & (s <= windows[w][1])
                if not fits.any():
                    continue
                r, v = np.concatenate([best[w][0], rows[fits]]), np.concatenate([best[w][1], s[fits]])
                order = np.lexsort((self.first[r], -v))[:k]
                best[w] = r[order], v[order]
                if len(order) == k:
                    need[w] = max(need[w], int(v[order[-1]]))

        heap, popped, waiting, step = [(-(u0[0] + u1[0]), 0, 0)], np.zeros(self.cell.shape, dtype=bool), 0, LEAST_STEP
        while heap:
            bound, p, r = heapq.heappop(heap)
            if -bound + eps < min(need[w] for w in open_):
                break
            popped[p, r] = True
            if p + 1 < len(u0) and (r == 0 or popped[p + 1, r - 1]):
                heapq.heappush(heap, (-(u0[p + 1] + u1[r]), p + 1, r))
            if r + 1 < len(u1) and (p == 0 or popped[p - 1, r + 1]):
                heapq.heappush(heap, (-(u0[p] + u1[r + 1]), p, r + 1))
            c = self.cell[by[0][p], by[1][r]]
            if c >= 0 and l0[p] + l1[r] - eps <= high:
                pending.append(np.arange(self.ends[c], self.ends[c + 1]))
                waiting += len(pending[-1])
                self.skipped -= len(pending[-1])
                if waiting >= step:
                    evaluate()
                    waiting, step = 0, min(STEP, 2 * step)
        if pending:
            evaluate()
        self.skipped += len(self.cls)
        return best


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dim).astype(np.float64)


def _needs(b: pa.RecordBatch, same: bool) -> Iterator[tuple]:
    """Per anchor: ask, label, marks, their windows, floors, home."""
    for ask, label, marks, floors, home in zip(*(b.column(c).to_pylist() for c in ("ask", "label", "marks", "floors", "home")), strict=True):
        yield ask, label, marks, [(NONE, -NONE)] if same else [window(m) for m in marks], floors, home


def _joint(build: Callable, answer: Callable):
    """Over rows sorted by (key, salt, role): role 0 rows of a (key, salt) make an object by ``build``, with
    which each later batch of role 1 rows is answered."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts, made = None, [], None
        for b in batches:
            key, salt, role = (b.column(c).to_numpy() for c in ("key", "salt", "role"))
            cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(salt) != 0) | (np.diff(role) != 0)) + 1
            for a, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                if a == e:
                    continue
                if (key[a], salt[a]) != group:
                    group, parts, made = (key[a], salt[a]), [], None
                if role[a] == 0:
                    parts.append(b.slice(a, e - a))
                elif parts:
                    made = build(pa.Table.from_batches(parts).combine_chunks()) if made is None else made
                    yield from answer(made, b.slice(a, e - a))
    return run


class Index:
    """Points (cls, first, label, x), their cells by shard, and the directory of the shards."""

    def __init__(self, points: DataFrame, n: int, dim: int, shard_rows: int = SHARD_ROWS, cell_rows: int = CELL_ROWS):
        spark = points.sparkSession
        self.dim, self.partitions = dim, int(spark.conf.get("spark.sql.shuffle.partitions"))
        cut = ((1 << 63) - 1) * min(n, 2 * SAMPLE) // n  # whole numbers: the sample stays bounded at any size
        sample = points.where(hash63(F.lit(3), "cls") <= F.lit(cut)) \
            .orderBy(hash63(F.lit(5), "cls"), "cls").limit(SAMPLE).select("x").collect()
        x = np.frombuffer(b"".join(bytes(r["x"]) for r in sample) or bytes(4 * dim), "<i4").reshape(-1, dim).astype(np.float64)
        words = max(1, min(MOST_WORDS, int(np.ceil(np.sqrt(n / cell_rows)))))
        self.half = max(1, dim // 2)
        self.books = books = (codebook(x[:, :self.half], words), codebook(x[:, self.half:], words))
        half = self.half

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = _rows(b.column("x"), dim)
                i, j = coded(v[:, :half], books[0]), coded(v[:, half:], books[1])
                far = [np.sqrt(((p - book[c]) ** 2).sum(axis=1)) for p, book, c in ((v[:, :half], books[0], i), (v[:, half:], books[1], j))]
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(far[0]), pa.array(far[1])],
                    ["cls", "first", "label", "x", "i", "j", "r1", "r2"])

        def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext
            pid = TaskContext.get().partitionId()
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, pid, np.int32)), *b.columns], ["shard", *b.schema.names])

        row = "cls long, first long, label int, x binary, i int, j int, r1 double, r2 double"
        assigned = materialize(points.select("cls", "first", "label", "x").mapInArrow(cells, row), "negatives-codes")
        self.cells = materialize(
            assigned.repartitionByRange(max(1, -(-n // shard_rows)), "i", "j", "cls").mapInArrow(numbered, "shard int, " + row),
            "negatives-cells")
        self.directory = materialize(
            self.cells.groupBy("shard", "i", "j").agg(F.max("r1").alias("r1"), F.max("r2").alias("r2")), "negatives-directory")
        self.groups = max(1, -(-self.directory.count() // DIRECTORY))

    def _meet(self, data: DataFrame, asks: DataFrame, run, schema: str) -> DataFrame:
        """Both sides by (key, salt): a key's anchors are dealt to as many tasks as they need, and only so
        often is the key's data copied; data of keys that nobody asks stays where it is."""
        sizes = asks.groupBy(F.col("key").alias("k0")).agg(F.ceil(F.count(F.lit(1)) / ANCHORS).cast("int").alias("salts"))
        same = F.col("key") == F.col("k0")
        data = (data.join(sizes, same).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
                .drop("k0", "salts").withColumn("role", F.lit(0)))
        asks = (asks.join(sizes, same).withColumn("salt", F.pmod(F.xxhash64("ask"), F.col("salts")).cast("int"))
                .drop("k0", "salts").withColumn("role", F.lit(1)))
        return (data.unionByName(asks, allowMissingColumns=True).repartition(self.partitions, "key", "salt")
                .sortWithinPartitions("key", "salt", "role").mapInArrow(run, schema))

    def visits(self, asks: DataFrame, same: bool, k: int) -> DataFrame:
        """Anchors (key = the shard to visit, ask, label, x, marks, floors, home) -> ask, mark, cls, first, score."""
        dim, books = self.dim, self.books

        def build(t: pa.Table) -> Shard:
            return Shard(*(t.column(c).to_numpy() for c in ("cls", "first", "label", "i", "j")), _rows(t.column("x"), dim), books)

        def answer(shard: Shard, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            for q, (ask, label, marks, windows, floors, _) in zip(_rows(b.column("x"), dim), _needs(b, same), strict=True):
                for mark, (rows, s) in zip(marks, shard.visit(q, label, same, windows, floors, k), strict=True):
                    out += zip([ask] * len(rows), [mark] * len(rows), shard.cls[rows].tolist(), shard.first[rows].tolist(), s.tolist(), strict=True)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["ask", "mark", "cls", "first", "score"])

        data = self.cells.select(F.col("shard").alias("key"), "cls", "first", "label", "i", "j", "x")
        return self._meet(data, asks, _joint(build, answer), "ask long, mark long, cls long, first long, score long")

    def routes(self, asks: DataFrame, same: bool) -> DataFrame:
        """ask, key: the shards besides its home whose bound reaches what an anchor still needs."""
        dim, half, books, groups = self.dim, self.half, self.books, self.groups

        def build(t: pa.Table):
            shard, i, j, r1, r2 = (t.column(c).to_numpy() for c in ("shard", "i", "j", "r1", "r2"))
            order = np.argsort(shard, kind="stable")
            shard, i, j, r1, r2 = shard[order], i[order], j[order], r1[order], r2[order]
            starts = np.flatnonzero(np.diff(shard, prepend=-1))
            return shard[starts], starts, i, j, r1, r2

        def answer(made, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            shards, starts, i, j, r1, r2 = made
            size = max(float(np.abs(x).max(initial=0.0)) for x in books) + max(float(r1.max()), float(r2.max()))
            found, to = [], []
            for q, (ask, _, _, windows, floors, home) in zip(_rows(b.column("x"), dim), _needs(b, same), strict=True):
                least = min((max(lo, f) for (lo, hi), f in zip(windows, floors, strict=True) if lo <= hi), default=None)
                if least is None:
                    continue
                a, c = q[:half], q[half:]
                bound = (books[0] @ a)[i] + np.sqrt((a ** 2).sum()) * r1 + (books[1] @ c)[j] + np.sqrt((c ** 2).sum()) * r2
                reach = np.maximum.reduceat(bound, starts) + slack(q) + 1e-6 + 1e-9 * size * size * dim
                go = shards[(reach >= least) & (shards != home)]
                found += [ask] * len(go)
                to += go.tolist()
            if to:
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(to, pa.int32())], ["ask", "key"])

        data = self.directory.withColumn("key", F.pmod(F.xxhash64("shard"), F.lit(groups)).cast("int"))
        everywhere = asks.withColumn("key", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        return self._meet(data, everywhere, _joint(build, answer), "ask long, key int")

    def first(self, asks: DataFrame, same: bool, k: int) -> DataFrame:
        """Per anchor (ask, label, x, marks, home) and mark the first ``k`` points: ask, mark, cls, score.
        ``same``: of the anchor's label; else of other labels with a score in the mark's window."""
        blank = F.transform("marks", lambda _: F.lit(NONE))
        here = materialize(self.visits(asks.withColumn("floors", blank).withColumn("key", F.col("home")), same, k), "negatives-home")
        floors = (here.groupBy(F.col("ask").alias("a0"), "mark").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s"))
                  .where(F.col("n") >= k).groupBy("a0").agg(F.map_from_entries(F.collect_list(F.struct("mark", "s"))).alias("known")))
        floor = F.transform("marks", lambda m: F.coalesce(F.try_element_at(F.col("known"), m), F.lit(NONE)))
        asks = materialize(asks.join(floors, F.col("ask") == F.col("a0"), "left").withColumn("floors", floor).drop("a0", "known"),
                           "negatives-asks")
        routes = materialize(self.routes(asks, same), "negatives-routes")
        to = routes.withColumnRenamed("ask", "a0")
        rest = self.visits(asks.join(to, F.col("ask") == F.col("a0")).drop("a0"), same, k)
        top = Window.partitionBy("ask", "mark").orderBy(F.desc("score"), "first", "cls")
        return (here.unionByName(rest).withColumn("r", F.row_number().over(top)).where(F.col("r") <= k)
                .select("ask", "mark", "cls", "score"))


def labelled_vectors(table: DataFrame, scale: int, label: Column) -> tuple[DataFrame, int]:
    """vec_id, label and x (components as floor(scale * component)) of the distinct rows that take part,
    and their dimension: no null ids or labels, no vectors that are null, empty, hold null or non-finite
    components, or differ in length from the commonest."""
    v = F.col("embedding")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = (table.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(fine)
            .select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("int").alias("label"),
                    F.transform(v, lambda c: F.floor(c.cast("double") * scale)).alias("x")))
    sizes = rows.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = sizes["dim"] if sizes else 0
    return rows.where(F.size("x") == dim).distinct(), dim


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = b.column(2)
        n = len(x)
        v = x.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))
        if np.abs(v).max(initial=0) > LARGEST:
            raise ValueError(f"a quantised component lies beyond {LARGEST}: 64-bit scores would not be exact")
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.astype("<i4").tobytes() for r in v], pa.binary())],
                                         ["vec_id", "label", "x"])


def mined(table: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = POSITIVES,
          negatives: int = NEGATIVES, scale: int = SCALE, shard_rows: int = SHARD_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """For every anchor (``is_anchor``, a condition on vec_id) and each of its first ``positives`` other rows
    of the same label, the first ``negatives`` rows of other labels whose score lies between LOW and HIGH
    hundredths of the positive's: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Higher scores come first, ties by smaller vec_id.  ``table`` has vec_id, embedding, label and any
    other columns; :func:`labelled_vectors` says which rows take part; ``label`` may change labels first.
    Rows that repeat id, label and vector count once; an id with several vectors or labels is several
    rows, each with lists of its own.  With fewer rows lists are shorter; a positive score below 0 admits
    no negatives.  An empty table gives no rows.  A component beyond ``LARGEST`` after quantising fails
    the job, as scores would not be exact.
    """
    spark = table.sparkSession
    rows, dim = labelled_vectors(table, scale, F.col("label") if label is None else label)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not dim:
        return spark.createDataFrame([], schema)
    rows = materialize(rows.mapInArrow(_packed, "vec_id long, label int, x binary"), "negatives-rows")
    enough = max(positives, negatives) + 1
    of = Window.partitionBy("x", "label").orderBy("vec_id")
    members = materialize(rows.withColumn("r", F.row_number().over(of)).where(F.col("r") <= enough), "negatives-members")
    points = materialize(members.where("r = 1").select(F.monotonically_increasing_id().alias("cls"), F.col("vec_id").alias("first"), "label", "x"),
                         "negatives-points")
    known = points.select("cls", F.col("label").alias("l0"), F.col("x").alias("x0"))
    same_point = (F.col("label") == F.col("l0")) & (F.col("x") == F.col("x0"))
    ids = materialize(members.select("vec_id", "label", "x").join(known, same_point).select("cls", "vec_id"), "negatives-ids")
    anchors = rows.where(is_anchor)
    anchors = materialize(anchors.join(known, same_point).select("vec_id", "cls"), "negatives-anchors")

    n = points.count()
    if not n:
        return spark.createDataFrame([], schema)
    index = Index(points, n, dim, shard_rows, cell_rows)
    asked = anchors.select(F.col("cls").alias("ask")).distinct()
    asking = materialize(asked.join(index.cells.select("cls", "label", "x", F.col("shard").alias("home")), F.col("ask") == F.col("cls"))
                         .drop("cls"), "negatives-asking")

    near = index.first(asking.withColumn("marks", F.array(F.lit(0).cast("long"))), True, positives + 1)
    by_id = Window.partitionBy("ask").orderBy(F.desc("score"), "positive_id", "own")
    near = materialize(
        near.join(ids.select(F.col("cls").alias("c0"), F.col("vec_id").alias("positive_id")), F.col("cls") == F.col("c0"))
        .withColumn("own", (F.col("cls") == F.col("ask"))).withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= positives + 1)
        .select("ask", "positive_id", "own", "score"), "negatives-near")
    order = Window.partitionBy("vec_id", "cls").orderBy(F.desc("score"), "positive_id", "own")
    pairs = materialize(
        anchors.join(small_side(near, 40), F.col("cls") == F.col("ask"))
        .where(~(F.col("own") & (F.col("positive_id") == F.col("vec_id"))))
        .withColumn("r", F.row_number().over(order)).where(F.col("r") <= positives)
        .select(F.col("vec_id").alias("anchor_id"), "cls", "positive_id", F.col("score").alias("positive_score")), "negatives-pairs")

    marks = pairs.groupBy(F.col("cls").alias("a1")).agg(F.sort_array(F.collect_set("positive_score")).alias("marks"))
    far = index.first(asking.join(marks, F.col("ask") == F.col("a1")).drop("a1"), False, negatives)
    by_score = Window.partitionBy("ask", "mark").orderBy(F.desc("score"), "negative_id")
    far = materialize(
        far.join(ids.select(F.col("cls").alias("c0"), F.col("vec_id").alias("negative_id")), F.col("cls") == F.col("c0"))
        .withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= negatives)
        .select("ask", "mark", F.col("rank").cast("int").alias("rank"), "negative_id", F.col("score").alias("negative_score")), "negatives-far")
    return (pairs.join(small_side(far, 48), (F.col("cls") == F.col("ask")) & (F.col("positive_score") == F.col("mark")))
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def every_hundredth(table: DataFrame) -> DataFrame:
    """The mined lists of rows whose vec_id is divisible by 100; first, where vec_id is divisible by 7,
    the label becomes (label + 1) % 10."""
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(table, F.col("vec_id") % 100 == 0, noisy)
