"""Learned per-model performance predictors over prompt embeddings (SVR- and MLP-style routers).

Spark has no support-vector regressor and no regression MLP, so both are fitted data-parallel, over one
layout and by one shape of pass:

* the training rows are packed once into *blocks* (a table row holds some thousand prompts of one group);
  which rows share a block, and their order in it, follow from the rows, not from tasks or Arrow batches;
* the weights are a table too, a row per group (eval family) and model or configuration.  A pass joins
  blocks with their group's weights, folds every block with numpy, adds the results in two grouped steps
  and moves the weights in tasks keyed by group.  The driver learns only whether any of them still moves:
  nothing it holds, and no closure, grows with the groups.

* linear: L2-regularised absolute-error fit (the objective of a linear SVR with epsilon 0) by iteratively
  reweighted least squares, with a certificate of its optimality (:func:`linear_certificate`).
* mlp: feed-forward nets per model (any hidden sizes, e.g. (100,) or (100, 100)), mini-batch Adam on
  squared error with L2 penalty; weights and optimiser state run through all batches of a block for ten
  epochs, and the blocks' weights are averaged by their rows once a pass.

NULL targets get weight 0 (rows with an unknown grade do not train that model).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelens.operators.meet import matrix, meet
from routelens.session import arrow_batches, materialize

#: Values of a chunk of a summed vector, vectors added in the first step.
CHUNK, FAN_IN = 1 << 16, 512
#: Bytes of the vectors of a block, blocks that travel to Python at once.
BLOCK_BYTES, BLOCKS_AT_ONCE = 4 << 20, 4


def _grp(group: str | None) -> F.Column:
    return F.col(group).cast("string") if group else F.lit("")


def training_blocks(train: DataFrame, dim: int, vec: str = "embedding", target: str = "perf", group: str | None = None,
                    key: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(grp, block, n, x, y)``: the training rows packed, x and y as rows of doubles (unknown grades NaN).

    ``key`` (a column; by default the row's own content) decides a row's block and place, so that equal
    inputs give equal blocks.  A block holds twice ``block_bytes`` at most, however often a key repeats.
    """
    partitions = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block_rows = max(1, block_bytes // (8 * dim))
    ident = [F.col(key)] if key else [F.col(vec), F.col(target)]
    rows = train.where(F.col(vec).isNotNull()).select(
        _grp(group).alias("grp"), F.xxhash64(F.lit(1), *ident).alias("h1"), F.xxhash64(F.lit(2), *ident).alias("h2"),
        F.col(vec).cast("array<double>").alias("vec"), F.col(target).cast("array<double>").alias("y"))
    sizes = rows.groupBy(F.col("grp").alias("g0")).agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))
    rows = (rows.join(sizes, F.col("grp").eqNullSafe(F.col("g0"))).withColumn("block", F.pmod("h1", "blocks"))
            .select("grp", "block", "h2", "vec", "y"))

    def pack(batches):
        held, of, at = [], None, 0

        def out():
            x, y = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            return pa.RecordBatch.from_arrays(
                [pa.array([of[0]], pa.string()), pa.array([of[1] * 1024 + at], pa.int64()), pa.array([len(x)], pa.int64()),
                 pa.array([x.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], ["grp", "block", "n", "x", "y"])

        for b in batches:
            grp, block = b.column("grp").to_pylist(), b.column("block").to_pylist()
            cuts = [0, *[i for i in range(1, len(grp)) if grp[i] != grp[i - 1] or block[i] != block[i - 1]], len(grp)]
            for a, e in zip(cuts, cuts[1:], strict=False):
                if a == e:
                    continue
                if (grp[a], block[a]) != of:
                    if held:
                        yield out()
                    held, of, at = [], (grp[a], block[a]), 0
                x, y = matrix(b.column("vec").slice(a, e - a), dim), matrix(b.column("y").slice(a, e - a))
                while len(x):
                    room = 2 * block_rows - sum(len(h[0]) for h in held)
                    if not room:
                        yield out()
                        held, at = [], at + 1
                        continue
                    held.append((x[:room], y[:room]))
                    x, y = x[room:], y[room:]
        if held:
            yield out()

    return materialize(
        rows.repartition(partitions, "grp", "block").sortWithinPartitions("grp", "block", "h2")
        .mapInArrow(pack, "grp string, block long, n long, x binary, y binary"), "training-blocks")


def _unpacked(r: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(r["x"]).reshape(r["n"], -1), np.frombuffer(r["y"]).reshape(r["n"], -1)


def _chunks(grp, net: int, v: np.ndarray) -> pa.RecordBatch:
    parts = [v[c:c + CHUNK].tolist() for c in range(0, len(v), CHUNK)]
    n = len(parts)
    return pa.RecordBatch.from_arrays([pa.array([grp] * n, pa.string()), pa.array([net] * n, pa.int32()), pa.array(range(n), pa.int32()),
                                       pa.array(parts, pa.list_(pa.float64()))], ["grp", "net", "c", "g"])


def _by_row(change):
    """Arrow batches with ``change`` applied to every row (a dict, changed in place); ``g`` is taken off."""
    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                change(r)
            fields = [f for f in b.schema if f.name != "g"]
            yield pa.RecordBatch.from_pylist([{f.name: r[f.name] for f in fields} for r in rows], schema=pa.schema(fields))
    return run


PARTS_SCHEMA = "grp string, net int, c int, g array<double>"


def _summed(parts: DataFrame, size: int, vectors: int) -> DataFrame:
    """``(grp, net, g)``: the element-wise sum of the partial vectors (of ``size`` values, ``vectors`` at most
    of each) by group and net.

    Vectors of several chunks are added chunk by chunk; more than ``FAN_IN`` of them in two steps, first
    those of up to ``FAN_IN`` neighbouring tasks: a task holds at most ``FAN_IN`` chunks of a key.  They are
    sorted first: equal vectors give equal sums, in whatever order they come.
    """
    add = F.aggregate(F.slice(F.col("l"), 2, F.greatest(F.size("l") - 1, F.lit(0))), F.col("l")[0],
                      lambda acc, x: F.zip_with(acc, x, lambda a, b: a + b))
    if vectors > FAN_IN:
        parts = parts.withColumn("s", F.floor(F.spark_partition_id() / FAN_IN)).groupBy("grp", "net", "c", "s").agg(
            F.sort_array(F.collect_list("g")).alias("l")).select("grp", "net", "c", add.alias("g"))
    parts = parts.groupBy("grp", "net", "c").agg(F.sort_array(F.collect_list("g")).alias("l")).select("grp", "net", "c", add.alias("g"))
    if size <= CHUNK:
        return parts.drop("c")
    return parts.groupBy("grp", "net").agg(F.array_sort(F.collect_list(F.struct("c", "g"))).alias("l")).select(
        "grp", "net", F.flatten(F.transform("l", lambda x: x["g"])).alias("g"))


# ------------------------------------------------------------------ linear

DELTA = 1e-4


def fit_linear_abs(train: DataFrame, n_models: int, dim: int, c: float = 1.0, rounds: int = 30, vec: str = "embedding",
                   target: str = "perf", group: str | None = None, tol: float = 1e-6, key: str | None = None,
                   blocks: DataFrame | None = None) -> DataFrame:
    """``(grp, net, theta, objective, rows)`` per group (e.g. eval family; ``""`` when ungrouped) and model
    ``net``: ``theta`` = weights and intercept, minimising 0.5 ||theta||^2 + c * sum |y - x theta|; the
    objective is that of the weights before the last step.  One pass per round serves every group and
    model; a model stops when its objective changes by less than ``tol`` (relative), the passes end when
    all have or after ``rounds``."""
    spark = train.sparkSession
    blocks = training_blocks(train, dim, vec, target, group, key) if blocks is None else blocks
    p, n_blocks = dim + 1, blocks.count()
    nets = (blocks.select("grp").distinct()
            .select("grp", F.explode(F.sequence(F.lit(0), F.lit(n_models - 1))).alias("net"))
            .select("grp", "net", F.array_repeat(F.lit(0.0), p).alias("theta"), F.lit(float("inf")).alias("objective"),
                    F.lit(0.0).alias("rows"), F.lit(True).alias("active"), F.lit(0).alias("seen")))
    nets = materialize(nets, "svr-weights")

    def width(seen: int) -> float:
        """Residuals below this count as squares: wide at first, for quick steps, then ``DELTA``."""
        return max(DELTA, 0.5 * 0.4 ** seen)

    def fold(batches):
        sums: dict = {}
        for b in batches:
            for r in b.to_pylist():
                x, y = _unpacked(r)
                x = np.hstack([x, np.ones((len(x), 1))])
                for m, theta, active, seen in ((t["net"], t["theta"], t["active"], t["seen"]) for t in r["nets"]):
                    if not active:
                        continue
                    known = ~np.isnan(y[:, m])
                    xk, yk = x[known], y[known, m]
                    e = np.abs(yk - xk @ np.array(theta))
                    w = 1.0 / np.maximum(e, width(seen)) if seen else np.ones(len(e))
                    g = sums.setdefault((r["grp"], m), np.zeros(p * p + p + 2))
                    g[:p * p] += ((xk * w[:, None]).T @ xk).ravel()
                    g[p * p:p * p + p] += (xk * w[:, None]).T @ yk
                    g[p * p + p:] += [e.sum(), len(e)]
        for (grp, m), g in sums.items():
            yield _chunks(grp, m, g)

    def step(r: dict) -> None:
        if r["g"] is None or not r["active"]:
            return
        g, theta = np.array(r["g"]), np.array(r["theta"])
        objective = 0.5 * float(theta @ theta) + c * float(g[p * p + p])
        moved = np.linalg.solve(c * g[:p * p].reshape(p, p) + np.eye(p), c * g[p * p:p * p + p])
        still = not (width(r["seen"] - 1) == DELTA and abs(r["objective"] - objective) <= tol * max(abs(objective), 1e-12))
        r.update(theta=moved.tolist() if still else r["theta"], objective=objective, rows=float(g[p * p + p + 1]), active=still,
                 seen=r["seen"] + 1)

    schema = "grp string, net int, theta array<double>, objective double, rows double, active boolean, seen int"
    with arrow_batches(spark, BLOCKS_AT_ONCE):
        for _ in range(rounds):
            now = nets.groupBy(F.col("grp").alias("g0")).agg(F.collect_list(F.struct("net", "theta", "active", "seen")).alias("nets"))
            joined = blocks.join(now, F.col("grp").eqNullSafe(F.col("g0"))).select("grp", "n", "x", "y", "nets")
            sums = _summed(joined.mapInArrow(fold, PARTS_SCHEMA), p * p + p + 2, n_blocks).select(F.col("grp").alias("g0"), F.col("net").alias("n0"), "g")
            nets = materialize(
                nets.join(sums, F.col("grp").eqNullSafe(F.col("g0")) & (F.col("net") == F.col("n0")), "left").drop("g0", "n0")
                .select("grp", "net", "theta", "objective", "rows", "active", "seen", "g").mapInArrow(_by_row(step), schema), "svr-weights")
            if nets.where("active").limit(1).count() == 0:
                break
    return nets.select("grp", "net", "theta", "objective", "rows")


def linear_weights_table(nets: DataFrame, group: str = "family") -> DataFrame:
    """Fitted weights by group: ``(group, w array<array<double>>, b array<double>)``."""
    by_model = F.array_sort(F.collect_list(F.struct("net", "theta")))
    p = F.size(F.col("t")[0]["theta"])
    return nets.groupBy(F.col("grp").alias(group)).agg(by_model.alias("t")).select(
        group, F.transform("t", lambda t: F.slice(t["theta"], F.lit(1), p - 1)).alias("w"),
        F.transform("t", lambda t: F.element_at(t["theta"], -1)).alias("b"))


def linear_scores(vec: str = "embedding") -> F.Column:
    """Predicted performance per model, JVM-side: dot(embedding, w[m]) + b[m] (after joining
    the weights table on the group)."""
    return F.transform(F.sequence(F.lit(0), F.size("b") - 1), lambda m: F.aggregate(
        F.zip_with(F.col(vec), F.col("w")[m], lambda a, b: a.cast("double") * b),
        F.col("b")[m], lambda s, x: s + x))


def linear_certificate(train: DataFrame, nets: DataFrame, n_models: int, dim: int, c: float = 1.0, vec: str = "embedding",
                       target: str = "perf", group: str | None = None) -> DataFrame:
    """``(grp, net, rows, objective, bound, gap)``: how far the weights may be from the optimum.

    The dual of the fit is: maximise sum(a y) - 0.5 ||sum(a x)||^2 over |a| <= c, one ``a`` a row; any such
    ``a`` bounds every objective from below.  Here a = c * clip(residual / s), which only the rows near the
    fit leave undecided, for several widths s, and the best bound counts.  Everything is one aggregate of
    the training rows joined with their weights: sums of |residual|, of a*y and of a*x per coordinate.
    """
    widths = [DELTA * 10 ** i for i in range(4)]
    w = linear_weights_table(nets, "g0")
    rows = train.where(F.col(vec).isNotNull()).select(_grp(group).alias("grp"), F.col(vec).cast("array<double>").alias("x"), F.col(target).alias("y"))
    j = rows.join(w, F.col("grp").eqNullSafe(F.col("g0"))).select(
        "grp", "x", F.posexplode("y").alias("net", "y"), "w", "b").where(F.col("y").isNotNull() & (F.col("net") < n_models))
    fit = F.aggregate(F.zip_with("x", F.col("w")[F.col("net")], lambda a, b: a * b), F.col("b")[F.col("net")], lambda s, v: s + v)
    j = j.select("grp", "net", "x", "y", (F.col("y") - fit).alias("r"))
    a = F.array(*[F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("r") / F.lit(s))) * F.lit(c) for s in widths])
    j = j.select("grp", "net", "x", "y", "r", F.posexplode(a).alias("width", "a"))
    coord = [F.sum(F.col("a") * F.col("x")[i]).alias(f"x{i}") for i in range(dim)]
    s = j.groupBy("grp", "net", "width").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.abs("r")).alias("loss"),
                                             F.sum(F.col("a") * F.col("y")).alias("ay"), F.sum("a").alias("a"), *coord)
    norm = sum((F.col(f"x{i}") * F.col(f"x{i}") for i in range(dim)), F.col("a") * F.col("a"))
    # a scaled a is feasible too as long as the scale is at most 1: the best scale maximises t * ay - t^2 norm / 2
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(norm > 0, F.col("ay") / norm).otherwise(F.lit(0.0))))
    bounds = s.groupBy("grp", "net").agg(F.max("rows").alias("rows"), F.max("loss").alias("loss"),
                                         F.max(t * F.col("ay") - F.lit(0.5) * t * t * norm).alias("bound"))
    size = nets.select(F.col("grp").alias("g1"), F.col("net").alias("n1"), F.aggregate("theta", F.lit(0.0), lambda s, v: s + v * v).alias("sq"))
    out = bounds.join(size, F.col("grp").eqNullSafe(F.col("g1")) & (F.col("net") == F.col("n1")))
    objective = F.lit(0.5) * F.col("sq") + F.lit(c) * F.col("loss")
    return out.select("grp", "net", "rows", objective.alias("objective"), "bound",
                      ((objective - F.col("bound")) / F.greatest(objective, F.lit(1e-12))).alias("gap"))


# --------------------------------------------------------------------- mlp

#: Every activation (in place where it can be) and its derivative, both of them from what the activation gave.
_ACT = {
    "relu": (lambda z: np.maximum(z, 0.0, out=z), lambda h: (h > 0).astype(np.float64)),
    "tanh": (lambda z: np.tanh(z, out=z), lambda h: 1.0 - h * h),
    "logistic": (lambda z: 1.0 / (1.0 + np.exp(-z)), lambda h: h * (1.0 - h)),
    "identity": (lambda z: z, lambda h: np.ones_like(h)),
}


def _layer_shapes(dim: int, hidden: tuple) -> list[tuple[int, int]]:
    sizes = [dim] + list(hidden) + [1]
    return [(sizes[i], sizes[i + 1]) for i in range(len(sizes) - 1)]


def _layers(theta: np.ndarray, shapes) -> list[tuple[np.ndarray, np.ndarray]]:
    """``theta`` (models x parameters) as [(W models x a x b, bias models x 1 x b), ...]."""
    out, o, m = [], 0, len(theta)
    for a, b in shapes:
        w = theta[:, o:o + a * b].reshape(m, a, b)
        o += a * b
        out.append((w, theta[:, o:o + b].reshape(m, 1, b)))
        o += b
    return out


def _mlp_forward(x: np.ndarray, theta: np.ndarray, shapes, activation: str = "relu") -> np.ndarray:
    """Predictions of every model's net: (rows, models)."""
    f, h, layers = _ACT[activation][0], x, _layers(theta, shapes)
    for i, (w, b) in enumerate(layers):
        z = np.matmul(h, w) + b
        h = z if i == len(layers) - 1 else f(z)
    return h[:, :, 0].T


BATCH = 200
LOCAL_EPOCHS = 10


def _train_block(theta: np.ndarray, on: np.ndarray, shapes, act: str, lr: float, x: np.ndarray, y: np.ndarray, alpha: float,
                 epochs: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Mini-batch Adam on 0.5 * squared error + alpha / (2 batch) * ||W||^2 over a block's rows, one optimiser
    state throughout; returns the weights after ``epochs`` and each model's squared error before.  Models that
    are not ``on`` keep their weights.

    Models share the rows' order and nothing else: an epoch trains one after another, whose weights, state and
    batch a processor's cache holds, and leaves out those that are not ``on``."""
    known = ~np.isnan(y)
    y0 = np.where(known, y, 0.0)
    sse = (((_mlp_forward(x, theta, shapes, act) - y0) * known) ** 2).sum(axis=0)
    rng, theta = np.random.default_rng(seed), theta.copy()
    nets = {m: _Adam(theta[m], shapes, act, lr, alpha) for m in np.flatnonzero(on)}
    for _ in range(epochs if nets else 0):
        order = rng.permutation(len(x))
        xs, ks, ys = x[order], np.ascontiguousarray(known[order].T), np.ascontiguousarray(y0[order].T)
        for m, net in nets.items():
            for at in range(0, len(x), BATCH):
                net.step(xs[at:at + BATCH], ys[m, at:at + BATCH, None], ks[m, at:at + BATCH, None])
    return theta, sse


class _Adam:
    """One net's optimiser; ``theta`` (its parameters) is changed in place."""

    def __init__(self, theta: np.ndarray, shapes, act: str, lr: float, alpha: float):
        self.theta, self.act, self.lr, self.alpha, self.t = theta, _ACT[act], lr, alpha, 0
        self.m1, self.v1, self.grad = np.zeros_like(theta), np.zeros_like(theta), np.empty_like(theta)
        self.move, self.size = np.empty_like(theta), np.empty_like(theta)
        self.layers, self.grads = ([(w[0], b[0, 0]) for w, b in _layers(v[None], shapes)] for v in (theta, self.grad))

    def step(self, x: np.ndarray, y: np.ndarray, k: np.ndarray) -> None:
        """One batch: rows, grades and which of these are known."""
        (f, df), last = self.act, len(self.layers) - 1
        hs, seen = [x], np.count_nonzero(k)
        n = max(float(seen), 1.0)
        for i, (w, b) in enumerate(self.layers):
            z = hs[-1] @ w
            z += b
            hs.append(z if i == last else f(z))
        dz = (hs[-1] - y) * k / n
        for i in range(last, -1, -1):
            (w, _), (up, bias) = self.layers[i], self.grads[i]
            np.matmul(hs[i].T, dz, out=up)
            up += self.alpha / n * w
            np.sum(dz, axis=0, out=bias)
            if i > 0:
                dz = dz * w.T if w.shape[1] == 1 else dz @ w.T
                dz *= df(hs[i])
        self.t += 1
        grad, m1, v1, move, size = self.grad, self.m1, self.v1, self.move, self.size
        np.multiply(grad, 0.001, out=size)
        size *= grad
        v1 *= 0.999
        v1 += size
        grad *= 0.1
        m1 *= 0.9
        m1 += grad
        if seen:
            np.divide(m1, 1 - 0.9 ** self.t, out=move)
            move *= self.lr
            np.divide(v1, 1 - 0.999 ** self.t, out=size)
            np.sqrt(size, out=size)
            size += 1e-8
            move /= size
            self.theta -= move


def _specs(configs: list[tuple], dim: int) -> list[tuple]:
    """(layer shapes, parameters of a net, activation, rate) per configuration (hidden, activation, rate)."""
    out = []
    for hidden, act, lr in configs:
        shapes = _layer_shapes(dim, tuple(hidden) if isinstance(hidden, (tuple, list)) else (int(hidden),))
        out.append((shapes, sum(a * b + b for a, b in shapes), act, lr))
    return out


NETS_SCHEMA = "grp string, net int, theta array<double>, best array<double>, stale array<int>, active array<boolean>"


def fit_mlp_grid(train: DataFrame, n_models: int, dim: int, configs: list[tuple], epochs: int = 30,
                 alpha: float = 1e-4, seed: int = 1234, vec: str = "embedding", target: str = "perf",
                 group: str | None = None, tol: float = 1e-4, n_iter_no_change: int = 10, key: str | None = None,
                 blocks: DataFrame | None = None) -> DataFrame:
    """Feed-forward nets for every configuration ``(hidden sizes, activation, learning rate)``,
    group and model, trained together: ``(grp, net, theta, ...)``, ``net`` the configuration's number and
    ``theta`` the parameters of all its models in turn.  Each pass runs ``LOCAL_EPOCHS`` epochs of
    mini-batch Adam (batches of ``BATCH``, the configuration's own rate) over every block and averages the
    blocks' weights by their rows: ``epochs`` cost ``epochs / LOCAL_EPOCHS`` passes.  A net stops once
    its loss has not improved by ``tol`` for ``n_iter_no_change`` epochs (the reference estimator's
    rule, seen once a pass); the passes end when every net has stopped or after ``epochs``."""
    spark = train.sparkSession
    blocks = training_blocks(train, dim, vec, target, group, key) if blocks is None else blocks
    spec, n_blocks = _specs(configs, dim), blocks.count()
    size = n_models * (max(per for _, per, _, _ in spec) + 2)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def start(r: dict) -> None:
        rng, parts = np.random.default_rng(seed), []
        for _ in range(n_models):
            for a, b in spec[r["net"]][0]:
                lim = np.sqrt(6.0 / (a + b))
                parts += [rng.uniform(-lim, lim, a * b), np.zeros(b)]
        r.update(theta=np.concatenate(parts).tolist(), best=[float("inf")] * n_models, stale=[0] * n_models, active=[True] * n_models)

    patience = max(1, n_iter_no_change // LOCAL_EPOCHS)

    def trainer(local: int, done: int):
        def fold(batches):
            for b in batches:
                for r in b.to_pylist():
                    (shapes, per, act, lr), on = spec[r["net"]], np.array(r["active"])
                    x, y = _unpacked(r)
                    theta = np.array(r["theta"]).reshape(n_models, per)
                    moved, sse = _train_block(theta, on, shapes, act, lr, x, y[:, :n_models], alpha, local, seed + done + r["block"] % 65536)
                    n = (~np.isnan(y[:, :n_models])).sum(axis=0)
                    # per model: weights x rows | rows | squared error before
                    yield _chunks(r["grp"], r["net"], np.hstack([moved * n[:, None], n[:, None], sse[:, None]]).ravel())
        return fold

    def step(r: dict) -> None:
        if r["g"] is None:
            return
        per, on = spec[r["net"]][1], np.array(r["active"])
        v, theta = np.array(r["g"]).reshape(n_models, per + 2), np.array(r["theta"]).reshape(n_models, per)
        best, n, sse = np.array(r["best"]), v[:, per], v[:, per + 1]
        loss = 0.5 * sse / np.maximum(n, 1.0)
        moved = on & (n > 0)
        stale = np.where(loss > best - tol, np.array(r["stale"]) + 1, 0)
        r.update(theta=np.where(moved[:, None], v[:, :per] / np.maximum(n, 1.0)[:, None], theta).ravel().tolist(),
                 best=np.where(moved, np.minimum(best, loss), best).tolist(), stale=stale.tolist(), active=(moved & (stale <= patience)).tolist())

    blank = [F.lit(None).cast(t).alias(c) for c, t in (("theta", "array<double>"), ("best", "array<double>"), ("stale", "array<int>"),
                                                       ("active", "array<boolean>"))]
    nets = blocks.select("grp").distinct().select("grp", F.explode(F.sequence(F.lit(0), F.lit(len(spec) - 1))).alias("net"), *blank)
    nets = materialize(nets.mapInArrow(_by_row(start), NETS_SCHEMA), "mlp-nets")
    with arrow_batches(spark, BLOCKS_AT_ONCE):
        for done in range(0, epochs, LOCAL_EPOCHS):
            moving = nets.where(F.exists("active", lambda a: a))
            joined = (blocks.join(moving.withColumnRenamed("grp", "g0"), F.col("grp").eqNullSafe(F.col("g0")))
                      .select("grp", "block", "n", "x", "y", "net", "theta", "active")
                      .repartition(partitions, "grp", "block", "net").sortWithinPartitions("grp", "net", "block"))
            sums = _summed(joined.mapInArrow(trainer(min(LOCAL_EPOCHS, epochs - done), done), PARTS_SCHEMA), size, n_blocks)
            sums = sums.select(F.col("grp").alias("g0"), F.col("net").alias("n0"), "g")
            nets = materialize(
                nets.join(sums, F.col("grp").eqNullSafe(F.col("g0")) & (F.col("net") == F.col("n0")), "left").drop("g0", "n0")
                .select("grp", "net", "theta", "best", "stale", "active", "g").mapInArrow(_by_row(step), NETS_SCHEMA), "mlp-nets")
            if nets.where(F.exists("active", lambda a: a)).limit(1).count() == 0:
                break
    return nets


def mlp_scores(df: DataFrame, nets: DataFrame, configs: list[tuple], n_models: int, dim: int, key: str, vec: str = "embedding",
               group: str | None = None) -> DataFrame:
    """``(key, net, scores array<double>[, group])``: every row's predictions under each configuration.

    Rows meet their group's nets in bounded tasks (:func:`meet`): no task holds more than one group's nets.
    """
    key_type = df.schema[key].dataType.simpleString()
    spec = _specs(configs, dim)
    rows = df.where(F.col(vec).isNotNull()).select(_grp(group).alias("key"), F.col(key).alias("row"), F.col(vec).cast("array<double>").alias("vec"))

    def build(t: pa.Table):
        return [(r["net"], np.array(r["theta"]).reshape(n_models, -1)) for r in t.to_pylist()]

    def answer(made, b: pa.RecordBatch):
        x = matrix(b.column("vec"), dim)
        for net, theta in made:
            scores = _mlp_forward(x, theta, spec[net][0], spec[net][2])
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array(np.full(len(x), net, np.int32)), pa.array(scores.tolist(), pa.list_(pa.float64())), b.column("key")],
                ["row", "net", "scores", "grp"])

    out = meet(nets.select(F.col("grp").alias("key"), "net", "theta"), rows, build, answer,
               f"row {key_type}, net int, scores array<double>, grp string", "row", 65536)
    out = out.withColumnRenamed("row", key)
    return out.withColumnRenamed("grp", group) if group else out.drop("grp")
