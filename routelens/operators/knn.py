"""Exact k-nearest-neighbour search with pruned cells, and neighbour-vote scores.

Plan (no cross join, no pair rows):

* the training rows of a group are cut into cells around pivots (chosen from a bounded sample, in tasks,
  one row set per group), and cells are laid out in shards of some thousand rows by a range partition, so
  that a hot group or cell is many shards;
* a cell's distance to its pivot's farthest row (its radius) bounds the distance of any query to any of
  its rows from below: d(query, pivot) - radius, by the triangle inequality.  Cosine uses the distance of
  unit vectors, which orders rows as the similarity does;
* a query first visits the shard of its nearest pivot; its k-th similarity there is the floor with which
  it is sent to those other shards alone that may hold a nearer row;
* inside a shard queries visit cells nearest bound first, whole batches of queries per numpy call, and stop
  as soon as the next bound lies beyond the running k-th distance;
* a final ``row_number() <= k`` per query (``WindowGroupLimit``) merges at most ``k`` rows per visited shard.

The result does not depend on the pivots: they decide what is skipped, not what is found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routelens.operators.meet import matrix, meet
from routelens.session import materialize

METRICS = ("cosine", "euclidean", "manhattan")
#: Bytes of a similarity block, training rows aimed at per cell, most pivots of a group.
CELL_BYTES, CELL_ROWS, MOST_PIVOTS = 64 << 20, 512, 1024
#: Pairs of one product of matrices, whose values a processor's cache holds.
PRODUCT = 1 << 19
#: Manhattan: stretches that the queries' values of a coordinate are cut into, rows whose products a cache holds,
#: queries from which a product is worth its while.
STRETCHES, SUM_ROWS, LEAST_SUMMED = 4, 512, 32
#: Rows that pivots are chosen from (per group), training rows of a shard.
SAMPLE, SHARD_ROWS = 4096, 1 << 18
#: Rows of a task where pivots are met; least and most queries of a task that searches a shard, and of a block.
TASK_ROWS, LEAST_QUERIES, MOST_QUERIES, BLOCK_QUERIES = 4096, 1024, 16384, 4096
#: Similarities are rounded to this many digits, equal ones rank by training id.
DIGITS = 9
#: Rows of the shard directory that one task holds.
DIRECTORY = 16384


def space(x: np.ndarray, metric: str) -> np.ndarray:
    """Coordinates in which the metric's order is that of a distance: unit vectors for cosine."""
    if metric != "cosine":
        return x
    n = np.sqrt((x * x).sum(axis=1))
    return x / np.where(n > 0, n, 1.0)[:, None]


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Every row of ``a`` against every row of ``b`` (points of :func:`space`)."""
    if metric == "manhattan":
        out, columns = np.zeros((len(a), len(b))), np.ascontiguousarray(b.T)
        step = max(1, (1 << 15) // max(1, len(b)))           # sums that a processor's cache holds
        one = np.empty((min(step, len(a)), len(b)))
        for s in range(0, len(a), step):
            total, part = out[s:s + step], one[:len(a) - s]
            for d, column in enumerate(columns):
                np.subtract(a[s:s + step, d, None], column, out=part)
                np.abs(part, out=part)
                total += part
        return out
    if metric == "euclidean":              # distances keep, cancellation shrinks
        a, b = a - b.mean(axis=0), b - b.mean(axis=0)
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2.0 * (a @ b.T), 0.0))


def margin(a: np.ndarray, b: np.ndarray, metric: str) -> float:
    """By how much rounding may move a similarity bound made from :func:`distances` of ``a`` and ``b``."""
    if metric == "cosine":
        return 10.0 ** -DIGITS * 3
    size = max((float(np.abs(v - b.mean(axis=0)).max(initial=0.0)) for v in (a, b)), default=0.0)
    return 10.0 ** -DIGITS * 2 + 1e-6 * size * np.sqrt(b.shape[1])


def choose_pivots(points: np.ndarray, n: int, metric: str, seed: int = 5, rounds: int = 6) -> np.ndarray:
    """About ``n`` pivots: k-means centres of the sample ``points``."""
    points = np.unique(points, axis=0)
    if len(points) <= n:
        return points
    pivots = points[np.random.default_rng(seed).choice(len(points), n, replace=False)]
    for _ in range(rounds):
        at = distances(points, pivots, metric).argmin(axis=1)
        seen = np.bincount(at, minlength=n)
        sums = np.zeros_like(pivots)
        np.add.at(sums, at, points)
        pivots = np.where(seen[:, None] > 0, sums / np.maximum(seen, 1)[:, None], pivots)
    return pivots


def cuts_of(points: np.ndarray, n: int) -> np.ndarray:
    """For every coordinate ``n + 1`` values from the least to the greatest, closer together where many lie."""
    out = np.empty((points.shape[1], n + 1))
    for d, v in enumerate(points.T):
        seen, edges = np.histogram(v, bins=64)
        share = np.concatenate([[0.0], np.cumsum(np.sqrt(seen))])
        out[d] = np.interp(np.linspace(0, share[-1], n + 1), share, edges)
        out[d, [0, -1]] = v.min(), v.max()
    return out


class Cells:
    """The training rows of one shard by cell, and the search for the nearest of them.

    ``visited`` counts the (query, cell) pairs that were measured, ``pairs`` all there were.
    """

    def __init__(self, metric: str, tids: np.ndarray, x: np.ndarray, cell: np.ndarray):
        rank = np.empty(len(tids), dtype=np.int64)
        rank[np.argsort(tids, kind="stable")] = np.arange(len(tids))
        self.metric, self.order = metric, np.lexsort((rank, cell))
        self.x, self.rank, cell = x[self.order], rank[self.order], cell[self.order]
        self.starts = np.flatnonzero(np.diff(cell, prepend=cell[:1] - 1))
        self.ends = np.append(self.starts[1:], len(cell))
        self.points = space(self.x, metric)
        # a cell's own centre is as good a pivot as the one that drew its border, and nearer to its rows
        self.pivots = np.stack([self.points[a:e].mean(axis=0) for a, e in zip(self.starts, self.ends, strict=True)])
        self.radius = np.array([distances(self.points[a:e], p[None], metric).max()
                                for a, e, p in zip(self.starts, self.ends, self.pivots, strict=True)])
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))
        self.rows = self.sizes = None          # for the search in single precision
        self.visited = self.pairs = 0

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The greatest similarity that a row of each cell may have to each query."""
        least = np.maximum(distances(space(q, self.metric), self.pivots, self.metric) - self.radius, 0.0)
        least = np.where(np.isnan(least), 0.0, least)
        if self.metric != "cosine":
            return -least
        # zero vectors have similarity 0 to everything
        has_zero = np.array([(self.norm[a:e] == 0).any() for a, e in zip(self.starts, self.ends, strict=True)])
        most = np.where(has_zero, np.maximum(1.0 - least ** 2 / 2, 0.0), 1.0 - least ** 2 / 2)
        return np.where((q * q).sum(axis=1)[:, None] > 0, most, 0.0)

    def exact(self, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Similarity of each query ``i`` to the row ``j``, in double precision; -inf where it is no number."""
        out = np.empty(len(i))
        step = max(1, CELL_BYTES // (32 * max(1, q.shape[1])))
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            for s in range(0, len(i), step):
                a, b = q[i[s:s + step]], self.x[j[s:s + step]]
                if self.metric == "cosine":
                    size = np.sqrt((a * a).sum(axis=1)) * self.norm[j[s:s + step]]
                    v = np.where(size == 0, 0.0, (a * b).sum(axis=1) / size)
                elif self.metric == "manhattan":
                    v = -np.abs(a - b).sum(axis=1)
                else:
                    v = -np.sqrt(((a - b) ** 2).sum(axis=1))
                out[s:s + step] = np.where(np.isfinite(v), np.round(v, DIGITS), -np.inf)
        return out

    def asking(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Queries as :meth:`likely` takes them: in single precision, what a row's value is short of, and the
        share of the sizes by which single precision may be off.  Doubles where those would not hold them."""
        share = 2e-7 * (q.shape[1] + 8)
        own, points = self.points, space(q, self.metric)
        if self.metric != "cosine":        # distances keep when all points move, sizes shrink
            with np.errstate(over="ignore", invalid="ignore"):
                centre = own.mean(axis=0)
            if np.isfinite(centre).all():
                own, points = own - centre, points - centre
        big = max(float(np.abs(own).max(initial=0.0)), float(np.abs(points).max(initial=0.0)))
        kind = np.float32 if big < 1e15 else np.float64
        if self.rows is None or self.rows.dtype != kind:
            x = own.astype(kind)
            with np.errstate(over="ignore"):
                self.sizes = (np.abs(x).sum(axis=1) if self.metric == "manhattan" else (x * x).sum(axis=1)).astype(np.float64)
            if self.metric == "euclidean":       # 2 q x - |x|^2, less the share that rounding may take
                self.rows = np.column_stack([x, (-(1 - share) * self.sizes).astype(kind)])
            else:
                self.rows = x
        if self.metric == "manhattan":
            return points.astype(kind), np.abs(points).sum(axis=1), share, self.placed(points, own) if kind is np.float32 else None
        if self.metric == "euclidean":
            with np.errstate(over="ignore"):
                return np.column_stack([2 * points, np.ones(len(q))]).astype(kind), (1 - share) * (points * points).sum(axis=1), share
        return points.astype(kind), np.zeros(len(q)), share

    def placed(self, points: np.ndarray, own: np.ndarray) -> tuple | None:
        """What a product of matrices bounds sums of absolute differences with: (own rows, the cuts of every
        coordinate, a row of factors a query, the queries' margin and what a bound may fall short at most).

        Between two cuts a distance |q - x| is the mean of the cuts' distances, weighed by where q lies, for any x
        outside of the two; for one between them the mean exceeds it by w / 2 at most (w: their gap, q in the
        middle; 2 t (1 - t) w at the share t), which is taken off."""
        if len(points) < LEAST_SUMMED or not (np.isfinite(points).all() and np.isfinite(own).all()):
            return None
        cuts, (n, dim) = cuts_of(points, STRETCHES), points.shape
        factors, wide, short, every = np.zeros((n, dim, 2 * STRETCHES + 1), np.float32), np.zeros(n), np.zeros(n), np.arange(n)
        for d in range(dim):
            j = np.clip(np.searchsorted(cuts[d], points[:, d], side="right") - 1, 0, STRETCHES - 1)
            w = cuts[d][j + 1] - cuts[d][j]
            t = np.clip((points[:, d] - cuts[d][j]) / np.where(w > 0, w, 1.0), 0.0, 1.0)
            over = 2 * t * (1 - t) * w
            factors[every, d, j], factors[every, d, j + 1], factors[every, d, STRETCHES + 1 + j] = 1 - t, t, -over
            wide += w
            short += over
        return own, cuts, factors.reshape(n, -1), wide, short

    def least(self, asked: tuple, part: np.ndarray, need: np.ndarray) -> np.ndarray:
        """The single-precision value that a row has at least if it reaches the query's need."""
        if self.metric == "euclidean":           # need: minus a distance, rounded
            return asked[1][part] - (10.0 ** -DIGITS - need) ** 2
        if self.metric == "manhattan":
            return need - self.off(asked, part, 0, len(self.x))
        return need - 2 * asked[2] - 10.0 ** -DIGITS

    def off(self, asked: tuple, part: np.ndarray, a: int, e: int) -> np.ndarray:
        """By how much a value of the rows ``a`` to ``e`` may be off."""
        if self.metric == "euclidean":
            return 2 * asked[2] * (asked[1][part] + float(self.sizes[a:e].max()))
        if self.metric == "manhattan":
            return asked[2] * (asked[1][part] + float(self.sizes[a:e].max())) + 2 * 10.0 ** -DIGITS
        return np.full(len(part), 2 * asked[2] + 2 * 10.0 ** -DIGITS)

    def reached(self, asked: tuple, qs: np.ndarray, value: np.ndarray, k: int, need: np.ndarray) -> np.ndarray:
        """The need of every query, raised to what its ``k``-th of these values says of its ``k``-th similarity."""
        known = np.flatnonzero(np.isfinite(value))
        qs, value = qs[known], value[known]
        if value.dtype == np.float32:            # one sort of whole numbers: by query, greatest value first
            bits = value.view(np.uint32)
            bits = np.where(bits >> 31, bits, ~bits & np.uint32(0x7FFFFFFF))
            key = np.sort((qs.astype(np.uint64) << np.uint64(32)) | bits)
            qs, bits = (key >> np.uint64(32)).astype(np.int64), key.astype(np.uint32)
            value = np.where(bits >> 31, bits, ~bits & np.uint32(0x7FFFFFFF)).view(np.float32)
        else:
            order = np.lexsort((-value, qs))
            qs, value = qs[order], value[order]
        start = np.flatnonzero(np.diff(qs, prepend=-1))
        full = start[np.diff([*start, len(qs)]) >= k]
        part, kth = qs[full], value[full + k - 1].astype(np.float64)
        out, off = need.copy(), self.off(asked, part, 0, len(self.x))
        with np.errstate(over="ignore", invalid="ignore"):
            if self.metric == "euclidean":
                sure = -(np.sqrt(np.maximum(asked[1][part] - kth + off, 0.0)) + 10.0 ** -DIGITS)
            else:
                sure = kth - off
        out[part] = np.fmax(out[part], sure)
        return out

    def likely(self, asked: tuple, part: np.ndarray, a: int, e: int, need: np.ndarray, k: int, sums: tuple | None = None) -> tuple:
        """Pairs (of ``part``, of the rows ``a`` to ``e``) among which are all that reach the need, of a query's
        first ``k`` in these rows, and their values; single precision finds them, :meth:`exact` decides."""
        n = e - a
        if self.metric == "manhattan":
            return self._likely_sums(asked, part, a, e, need, k, sums)
        points, own = asked[0][part], asked[1][part]
        with np.errstate(over="ignore", invalid="ignore"):
            value = points @ self.rows[a:e].T
            least, off = self.least(asked, part, need), self.off(asked, part, a, e)
            if n > k:
                # a loose need lets all rows through: the k-th of these rows is a need too
                loose = np.flatnonzero(~np.isfinite(need))
                if len(loose):
                    kth = np.partition(value[loose], n - k, axis=1)[:, n - k]
                    if self.metric == "euclidean":   # as the distance is rounded
                        far = np.sqrt(np.maximum(own[loose] - kth, 0.0)) + 10.0 ** -DIGITS
                        kth = own[loose] - far ** 2
                    least[loose] = np.maximum(least[loose], kth - 2 * off[loose])
            least = np.nextafter(least.astype(value.dtype), value.dtype.type(-np.inf))
            at = np.flatnonzero(~(value < least[:, None]))
        return at // n, a + at % n, value.ravel()[at]

    def sums(self, asked: tuple, a: int, e: int) -> np.ndarray:
        """The other factors of :meth:`placed`, a column for each of the rows ``a`` to ``e``."""
        own, cuts = asked[3][:2]
        x, n = own[a:e, :, None], STRETCHES + 1
        out = np.empty((*x.shape[:2], 2 * STRETCHES + 1), np.float32)
        out[:, :, :n] = np.abs(x - cuts)
        out[:, :, n:] = (x >= cuts[:, :-1]) & (x <= cuts[:, 1:])
        return out.reshape(e - a, -1).T

    def _likely_sums(self, asked: tuple, part: np.ndarray, a: int, e: int, need: np.ndarray, k: int, sums: np.ndarray | None) -> tuple:
        """As :meth:`likely` for sums of absolute differences: a product of matrices bounds them from below, and
        the pairs that it leaves over are added up one by one."""
        n, points = e - a, asked[0]
        off = self.off(asked, part, a, e)
        with np.errstate(over="ignore", invalid="ignore"):
            if sums is None:
                at = np.arange(len(part) * n)
            else:
                bound = asked[3][2][part] @ sums
                margin = 3 * asked[2] * (asked[1][part] + float(self.sizes[a:e].max()) + asked[3][3][part]) + 2 * 10.0 ** -DIGITS
                most = margin - need
                loose = np.flatnonzero(~np.isfinite(most))
                if len(loose) and n > k:         # the k-th of these rows is a need too
                    most[loose] = np.partition(bound[loose], k - 1, axis=1)[:, k - 1] + asked[3][4][part[loose]] + 2 * margin[loose]
                most = np.nextafter(most.astype(bound.dtype), bound.dtype.type(np.inf))
                at = np.flatnonzero(~(bound > most[:, None]))
            i, j = at // n, a + at % n
            value, step = np.empty(len(i), points.dtype), max(64, (1 << 15) // max(1, points.shape[1]))
            one, two = np.empty((2, min(step, len(i)), points.shape[1]), points.dtype)
            ones = np.ones(points.shape[1], points.dtype)
            of = part[i]
            for s in range(0, len(i), step):
                m = min(step, len(i) - s)
                np.take(points, of[s:s + m], axis=0, out=one[:m], mode="clip")
                np.take(self.rows, j[s:s + m], axis=0, out=two[:m], mode="clip")
                one -= two
                np.abs(one, out=one)
                np.dot(one[:m], ones, out=value[s:s + m])
            value = -value
            least = np.nextafter((need - off).astype(value.dtype), value.dtype.type(-np.inf))
            keep = ~(value < least[i])
        return i[keep], j[keep], value[keep]

    def pieces(self, c: int) -> list[tuple[int, int]]:
        """The rows of a cell, in pieces where tables are made for them."""
        a, e = int(self.starts[c]), int(self.ends[c])
        n = max(1, -(-(e - a) // SUM_ROWS)) if self.metric == "manhattan" else 1
        cut = [a + (e - a) * i // n for i in range(n + 1)]
        return list(zip(cut, cut[1:], strict=False))

    def first(self, k: int, found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The first ``k`` of every query's finds, in order, and each one's place."""
        qs, rows, sims = (np.concatenate(v) for v in zip(*found, strict=True))
        order = np.lexsort((self.rank[rows], -sims, qs))
        qs, rows, sims = qs[order], rows[order], sims[order]
        start = np.flatnonzero(np.diff(qs, prepend=-1))
        place = np.arange(len(qs)) - np.repeat(start, np.diff([*start, len(qs)]))
        keep = place < k
        return qs[keep], rows[keep], sims[keep], place[keep]

    def nearest(self, q: np.ndarray, k: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, similarity) of the first ``k`` rows of every query, those below its floor left out.

        Every query measures the cell it may be nearest to, whose k-th is a need; then cell after cell meets
        all queries that may find a row there above their need, in one product of matrices.  The k-th of the
        single-precision values raises the need as well, so that few finds are left for doubles."""
        most, asked = self.bounds(q), self.asking(q)
        need, home = floors.copy(), most.argmax(axis=1) if len(q) else np.zeros(0, np.int64)
        tie = margin(space(q, self.metric), self.points, self.metric)
        found, pending = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0
        waiting, held, fresh = [], 0, 0      # finds in single precision, not yet measured in doubles; new ones
        self.pairs += most.size

        def decide(i, j):
            nonlocal pending
            value = self.exact(q, i, j)
            good = (value > -np.inf) & (value >= need[i])
            found.append((i[good], j[good], value[good]))
            pending += int(good.sum())

        def settle(last=False):
            nonlocal found, pending, waiting, held, fresh, need
            if waiting:
                i, j, value = (np.concatenate(v) for v in zip(*waiting, strict=True))
                need = self.reached(asked, i, value, k, need)
                stay = ~(value < np.nextafter(self.least(asked, i, need[i]).astype(value.dtype), value.dtype.type(-np.inf)))
                i, j, value = i[stay], j[stay], value[stay]
                # what values can't tell apart (many copies, say) is for doubles and ids
                if last or len(i) > max(4 * len(q) * k, 1 << 16):
                    decide(i, j)
                    waiting, held = [], 0
                else:
                    waiting, held = [(i, j, value)], len(i)
                fresh = 0
            if pending:
                qs, rows, sims, place = self.first(k, found)
                end = place == k - 1
                need[qs[end]] = np.maximum(need[qs[end]], sims[end])
                found, pending = [(qs, rows, sims)], 0

        def measure(part, c):
            nonlocal fresh
            self.visited += len(part)
            for a, e in self.pieces(c):
                step = max(64, PRODUCT // (e - a))
                sums = self.sums(asked, a, e) if self.metric == "manhattan" and asked[3] and len(part) >= LEAST_SUMMED else None
                for s in range(0, len(part), step):
                    some = part[s:s + step]
                    i, j, value = self.likely(asked, some, a, e, need[some], k, sums)
                    waiting.append((some[i], j, value))
                    fresh += len(i)
                    if max(pending, fresh) > max(len(q) * k, 1 << 16):
                        settle()

        by = np.argsort(home, kind="stable")
        own = home[by]
        at = np.flatnonzero(np.diff(own, prepend=-1))
        for s, t in zip(at, np.append(at[1:], len(own)), strict=True):
            part, c = by[s:t], own[s]
            part = part[~(most[part, c] < need[part] - tie)]
            if len(part):
                measure(part, c)
        settle()
        # cells that more queries hold near come first: they raise the needs
        order = np.argsort(-np.bincount(np.argsort(-most, axis=1)[:, :8].ravel(), minlength=most.shape[1]), kind="stable") if len(q) else []
        for n, c in enumerate(order):
            part = np.flatnonzero(~(most[:, c] < need - tie) & (home != c))
            if len(part):
                measure(part, c)
            if n % 8 == 7 and (pending or 2 * fresh > held):
                settle()
        settle(last=True)
        qs, rows, sims = found[0]
        keep = sims >= floors[qs] if len(qs) else np.zeros(0, bool)
        return qs[keep], self.order[rows[keep]], sims[keep]


def _group(cols: list[str]) -> F.Column:
    return F.to_json(F.struct(*[F.col(c) for c in cols])) if cols else F.lit("")


class _Index:
    """The training rows' cells and shards, and every row's nearest pivot on both sides."""

    def __init__(self, queries: DataFrame, train: DataFrame, metric: str, carried: list[str], shard_rows: int, cell_rows: int):
        self.metric = metric
        sizes = train.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
        sampled = (train.join(sizes, "grp")
                   .where(F.xxhash64(F.lit(17), "tid").bitwiseAND(F.lit((1 << 62) - 1)).cast("double")
                          < F.lit(float(SAMPLE << 62)) / F.col("n"))
                   .select("grp", "n", "vec"))
        most = MOST_PIVOTS

        def pivots_of(batch):
            import pandas as pd
            x = space(np.stack(batch["vec"].to_numpy()).astype(np.float64), metric)
            p = choose_pivots(x, max(1, min(most, -(-int(batch["n"].iloc[0]) // cell_rows))), metric)
            return pd.DataFrame({"grp": batch["grp"].iloc[0], "cell": np.arange(len(p), dtype=np.int32), "pivot": list(p)})

        # the sample of a group has SAMPLE rows or so, whatever the group's size; a group that is so unlucky
        # as to get none (it would have to be tiny) keeps its first row
        least = train.groupBy("grp").agg(F.min_by("vec", "tid").alias("vec")).withColumn("n", F.lit(1).cast("long"))
        sampled = sampled.unionByName(least)
        self.pivots = materialize(sampled.groupBy("grp").applyInPandas(pivots_of, "grp string, cell int, pivot array<double>"), "knn-pivots")

        both = train.withColumn("asks", F.lit(False)).unionByName(queries.withColumn("asks", F.lit(True)), allowMissingColumns=True)
        kinds = {f.name: f.dataType for f in both.schema}
        fields = [c for c in both.columns if c != "grp"]
        schema = T.StructType([T.StructField("grp", T.StringType()), T.StructField("cell", T.IntegerType()),
                               T.StructField("far", T.DoubleType()), *[T.StructField(c, kinds[c]) for c in fields]])

        def build(t: pa.Table):
            cell = t.column("cell").to_numpy()
            order = np.argsort(cell)
            return cell[order], matrix(t.column("pivot"))[order]

        def assign(made, b: pa.RecordBatch):
            cell, pivots = made
            x = matrix(b.column("vec"), pivots.shape[1])
            good = np.isfinite(x).all(axis=1)          # rows with other components are nobody's neighbours
            d = distances(space(np.where(good[:, None], x, 0.0), metric), pivots, metric)
            at = d.argmin(axis=1)
            out = pa.RecordBatch.from_arrays(
                [b.column("key"), pa.array(cell[at]), pa.array(d[np.arange(len(at)), at]), *[b.column(c) for c in fields]],
                ["grp", "cell", "far", *fields])
            yield out.filter(pa.array(good))

        rows = both.withColumnRenamed("grp", "key").withColumn("spread", F.coalesce(F.col("tid").cast("string"), F.col("qid").cast("string")))
        assigned = materialize(
            meet(self.pivots.withColumnRenamed("grp", "key"), rows, build, assign, schema, "spread", 8 * TASK_ROWS), "knn-assigned")

        def numbered(batches):
            from pyspark import TaskContext
            pid = TaskContext.get().partitionId()
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, pid, np.int32)), *b.columns], ["pid", *b.schema.names])

        kept = ["grp", "cell", "far", "tid", "vec", *carried]
        data = assigned.where(~F.col("asks")).select(*kept)
        shards = max(1, -(-data.count() // shard_rows))
        pid = T.StructField("pid", T.IntegerType())
        self.data = materialize(
            data.repartitionByRange(shards, "grp", "cell", "tid")
            .mapInArrow(numbered, T.StructType([pid, *[data.schema[c] for c in kept]])), "knn-shards")
        # a row per shard and cell: shards hold thousands of rows
        self.directory = materialize(self.data.groupBy("grp", "pid", "cell").agg(F.max("far").alias("far")), "knn-directory")
        self.several = self.directory.select("grp", "pid").distinct().groupBy("grp").count().where("count > 1").limit(1).count() > 0
        self.asks = assigned.where("asks").drop("asks", "tid", "far", *carried)
        self.n_asks = self.asks.count()

    def _key(self) -> F.Column:
        return F.concat_ws("/", F.col("pid").cast("string"), F.col("grp"))

    def visits(self, asks: DataFrame, n: int, k: int, out: T.StructType, carried: list[str], payload: list[str]) -> DataFrame:
        """``n`` queries (key = the shard to visit, qid, vec, floor, ...) -> their nearest rows in that shard."""
        metric, names = self.metric, out.names
        cores = self.data.sparkSession.sparkContext.defaultParallelism
        task_rows = min(MOST_QUERIES, max(LEAST_QUERIES, -(-n // (2 * cores))))

        def build(t: pa.Table):
            tids = t.column("tid").to_numpy() if pa.types.is_integer(t.column("tid").type) else np.array(t.column("tid").to_pylist(), dtype=object)
            return t, Cells(metric, tids, matrix(t.column("vec")), t.column("cell").to_numpy())

        def answer(made, b: pa.RecordBatch):
            t, cells = made
            q = matrix(b.column("vec"), cells.x.shape[1])
            floors = b.column("floor").to_numpy(zero_copy_only=False)
            for s in range(0, len(q), BLOCK_QUERIES):
                i, row, sim = cells.nearest(q[s:s + BLOCK_QUERIES], k, floors[s:s + BLOCK_QUERIES])
                if len(i):
                    i, row = pa.array(i + s), pa.array(row)
                    got = {**{c: b.column(c).take(i) for c in (*carried, "qid")},
                           **{c: t.column(c).take(row).combine_chunks() for c in ("tid", *payload)}, "sim": pa.array(sim)}
                    yield pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in
                                                      (got[c] for c in names)], names)

        data = self.data.select(self._key().alias("key"), "cell", "tid", "vec", *payload)
        # a task reads a copy of its shard: more partitions than tasks, lest many share one
        return meet(data, asks, build, answer, out, "qid", task_rows, 3 * -(-n // task_rows))

    def homes(self) -> DataFrame:
        """Every query with the shard that holds (the first rows of) its nearest pivot's cell."""
        home = self.directory.groupBy("grp", "cell").agg(F.min("pid").alias("pid"))
        anywhere = self.directory.groupBy("grp").agg(F.min("pid").alias("any"))
        return (self.asks.join(home, ["grp", "cell"], "left").join(anywhere, "grp")
                .withColumn("pid", F.coalesce("pid", "any")).drop("any"))

    def routes(self, asks: DataFrame) -> DataFrame:
        """(grp, qid, pid) for the shards besides its home that may hold a row above the query's floor."""
        metric = self.metric
        kind = {f.name: f.dataType for f in asks.schema}["qid"]
        rows = self.directory.join(self.pivots, ["grp", "cell"])
        groups = max(1, -(-self.directory.count() // DIRECTORY))

        def build(t: pa.Table):
            order = np.argsort(t.column("shard").to_numpy(), kind="stable")
            shard = t.column("shard").to_numpy()[order]
            starts = np.flatnonzero(np.diff(shard, prepend=-1))
            return shard[starts], starts, t.column("far").to_numpy()[order], matrix(t.column("pivot"))[order]

        def answer(made, b: pa.RecordBatch):
            shards, starts, far, pivots = made
            q = matrix(b.column("vec"), pivots.shape[1])
            floor, home = b.column("floor").to_numpy(zero_copy_only=False), b.column("pid").to_numpy()
            points = space(q, metric)
            least = np.minimum.reduceat(np.maximum(distances(points, pivots, metric) - far, 0.0), starts, axis=1)
            tie = margin(points, pivots, metric) + 1e-6 * float(far.max(initial=0.0)) * (metric != "cosine")
            if metric == "cosine":   # a zero vector's similarity is 0, whatever its distance
                most = np.where((q * q).sum(axis=1)[:, None] > 0, np.maximum(1.0 - least ** 2 / 2, 0.0), 0.0)
            else:
                most = -least
            i, j = np.nonzero(~(most < floor[:, None] - tie) & (shards != home[:, None]))
            if len(i):
                yield pa.RecordBatch.from_arrays([b.column("grp").take(pa.array(i)), b.column("qid").take(pa.array(i)),
                                                  pa.array(shards[j].astype(np.int32))], ["grp", "qid", "pid"])

        part = F.pmod(F.xxhash64("pid"), F.lit(groups)).cast("string")
        reference = rows.select(F.concat_ws("/", part, F.col("grp")).alias("key"), F.col("pid").alias("shard"), "far", "pivot")
        others = (asks.select("grp", "qid", "vec", "floor", "pid", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
                  .withColumn("key", F.concat_ws("/", F.col("part").cast("string"), F.col("grp"))).drop("part"))
        schema = T.StructType([T.StructField("grp", T.StringType()), T.StructField("qid", kind), T.StructField("pid", T.IntegerType())])
        return meet(reference, others, build, answer, schema, "qid", TASK_ROWS)


def knn_topk(queries: DataFrame, train: DataFrame, k: int, group_cols: list[str], qid: str = "sample_id",
             tid: str = "sample_id", vec: str = "embedding", metric: str = "cosine", payload: str | None = None,
             shard_rows: int = SHARD_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Top-``k`` training rows of every query within its group.

    Returns ``(group..., query_id, neighbor_id, sim, rank[, payload])``; ``sim`` is the
    similarity (negated distance for euclidean/manhattan) rounded to 1e-9, ties
    broken by the smaller training id.  ``payload`` (a training column) is
    carried along so that scoring needs no join back to the training table.
    Rows whose vector is null or holds other than finite numbers, or whose group is null, take no part;
    a query is known by its group and id.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    there = [F.col(c).isNotNull() for c in (*group_cols, vec)]
    for c in there:
        queries, train = queries.where(c), train.where(c)
    payload_cols = [payload] if payload else []
    # single precision stays as it is on its way, half the bytes of doubles
    kinds = {df.schema[vec].dataType.simpleString() for df in (queries, train)}
    held = F.col(vec).cast("array<float>" if kinds == {"array<float>"} else "array<double>").alias("vec")
    q = queries.select(_group(group_cols).alias("grp"), *group_cols, F.col(qid).alias("qid"), held)
    t = train.select(_group(group_cols).alias("grp"), F.col(tid).alias("tid"), held, *payload_cols)
    out = T.StructType([*[queries.schema[c] for c in group_cols], T.StructField("qid", queries.schema[qid].dataType),
                        T.StructField("tid", train.schema[tid].dataType), T.StructField("sim", T.DoubleType()),
                        *[T.StructField(c, train.schema[c].dataType) for c in payload_cols]])
    index = _Index(q, t, metric, payload_cols, shard_rows, cell_rows)
    lowest = F.lit(float("-inf"))
    homes = index.homes().withColumn("floor", lowest)
    if index.several:
        homes = materialize(homes, "knn-homes")
    near = index.visits(homes.withColumn("key", index._key()), index.n_asks, k, out, group_cols, payload_cols)
    if index.several:
        near = materialize(near, "knn-home-finds")
        by = [*group_cols, "qid"]
        floors = (near.groupBy(_group(group_cols).alias("grp"), "qid").agg(F.count(F.lit(1)).alias("found"), F.min("sim").alias("kth"))
                  .where(F.col("found") >= k).select("grp", "qid", "kth"))
        asks = materialize(homes.drop("floor").join(floors, ["grp", "qid"], "left").withColumn("floor", F.coalesce("kth", lowest)).drop("kth"),
                           "knn-asks")
        to = materialize(index.routes(asks), "knn-routes")
        rest = index.visits(asks.drop("pid").join(to, ["grp", "qid"]).withColumn("key", index._key()), to.count(), k, out, group_cols, payload_cols)
        w = Window.partitionBy(*by).orderBy(F.col("sim").desc(), F.col("tid"))
        near = near.unionByName(rest)
    else:
        w = Window.partitionBy(*group_cols, "qid").orderBy(F.col("sim").desc(), F.col("tid"))
    ranked = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.withColumnRenamed("qid", "query_id").withColumnRenamed("tid", "neighbor_id").select(
        *group_cols, "query_id", "neighbor_id", "sim", *payload_cols, "rank")


def neighbor_scores(neighbors: DataFrame, ks: list[int], n_models: int, group_cols: list[str],
                    perf_col: str = "perf") -> DataFrame:
    """Mean performance of the ``k`` nearest neighbours per query and model, for every k.

    ``neighbors`` carries ``perf``: the neighbour's dense performance vector (by
    model index).  One neighbour row feeds every k >= its rank (a generator), and a
    single aggregate per (k, query) averages the vectors (NULLs skipped).
    """
    kk = F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k >= F.col("rank"))
    x = neighbors.select(*group_cols, "query_id", F.explode(kk).alias("k"), perf_col)
    aggs = [F.avg(F.col(perf_col)[i]).alias(f"_s{i}") for i in range(n_models)]
    g = x.groupBy(*group_cols, "k", "query_id").agg(*aggs)
    return g.select(*group_cols, "k", "query_id", F.array(*[F.col(f"_s{i}") for i in range(n_models)]).alias("scores"))
