"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class is a normal density over the same vector of statistics (logs of counts, logits of shares,
standardised).  Class covariances are shrunk twice: towards the pooled covariance, and towards its
mean variance on the diagonal; both amounts are those with the least loss on a fold that the moments
did not see.  A score is the difference of the two log densities (Mahalanobis distances through the
Cholesky factors, which are worked out once and travel with the model), mapped to a probability by a
logistic curve fitted on the same fold.

Moments cover all labelled training rows: each task sends one sum of the vectors and one of their
products per class, whatever its rows.  Rows of a fold are told by crc32(doc_id as text) mod 5: 0 is
held out, 1 selects and calibrates, 2 to 4 train.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelens.llm.toxicity import fold_of, labelled
from routelens.session import materialize

#: Shrinkage amounts tried, and bins of the histogram that the logistic curve is fitted on.
POOL = (0.05, 0.25, 0.6)
DIAGONAL = (0.01, 0.1, 0.3)
BINS = 4000
SPAN = 60.0
THRESHOLD = 0.3

STATISTICS = ("words", "word_length", "length_spread", "distinct", "top_word", "repeats", "lines", "line_words",
              "line_repeats", "upper", "digits", "marks", "symbols", "high", "ends", "entropy", "short", "alike_ends")


def _logit(share: float, weight: float) -> float:
    """Log odds of a share observed over ``weight`` items, a half added to either side."""
    return float(np.log((share * weight + 0.5) / ((1 - share) * weight + 0.5)))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text; an empty text is one of zero words."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    raw = text.encode()
    by = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    size = len(raw)
    counts = Counter(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
    lines = [x for x in text.split("\n") if x]
    share = by[by > 0] / size
    common = counts.most_common(1)[0][1]
    marks = int(by[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum())
    symbols = int(by[[35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 124, 125, 126]].sum())
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    last = Counter(w[-1] for w in words)
    return [
        float(np.log1p(n)), float(np.log(sizes.mean())), float(np.log1p(sizes.std())),
        _logit(len(counts) / n, n), _logit(common / n, n), _logit(repeats / n, n),
        float(np.log1p(len(lines))), float(np.log1p(n / max(1, len(lines)))),
        _logit(1 - len(set(lines)) / max(1, len(lines)), max(1, len(lines))),
        _logit(by[65:91].sum() / size, size), _logit(by[48:58].sum() / size, size), _logit(marks / size, size),
        _logit(symbols / size, size), _logit(by[128:].sum() / size, size),
        _logit(sum(w[-1] in ".!?" for w in counts) / len(counts), len(counts)),
        float(-(share * np.log(share)).sum()), _logit(float((sizes <= 3).mean()), n),
        _logit(last.most_common(1)[0][1] / n, n)]


def vectors(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=float).reshape(-1, len(STATISTICS))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per class and task: count, sum of the vectors and of their products, flattened."""
    held: dict[int, np.ndarray] = {}
    for b in batches:
        x, y = np.array(b.column(0).to_pylist(), dtype=float).reshape(-1, len(STATISTICS)), b.column(1).to_numpy()
        one = np.hstack([np.ones((len(x), 1)), x])
        for c in np.unique(y).tolist():
            z = one[y == c]
            held[c] = held.get(c, 0) + z.T @ z
    for c, m in held.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([c] * m.size, pa.int32()), pa.array(np.arange(m.size), pa.int32()), pa.array(m.ravel())],
            ["y", "i", "v"])


def class_moments(rows: DataFrame) -> dict[int, np.ndarray]:
    """Per class the matrix of sums of (1, x) outer products over all ``rows`` (x, y)."""
    d = len(STATISTICS) + 1
    got = (rows.select("x", "y").mapInArrow(_moments, "y int, i int, v double")
           .groupBy("y", "i").agg(F.sum("v").alias("v")).collect())  # classes x (statistics + 1) squared
    out: dict[int, np.ndarray] = {}
    for r in got:
        out.setdefault(r["y"], np.zeros(d * d))[r["i"]] = r["v"]
    return {c: m.reshape(d, d) for c, m in out.items()}


@dataclass
class Discriminant:
    """Two normal densities with cached Cholesky factors, and a logistic curve over their difference."""
    shift: np.ndarray
    scale: np.ndarray
    means: tuple
    factors: tuple
    logdets: tuple
    slope: float = 1.0
    bias: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.shift) / self.scale, -8.0, 8.0)
        logs = [-0.5 * (np.linalg.solve(f, (z - m).T) ** 2).sum(axis=0) - 0.5 * ld
                for m, f, ld in zip(self.means, self.factors, self.logdets, strict=True)]
        return logs[1] - logs[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        d = np.clip(self.difference(x), -SPAN, SPAN)
        return 1 / (1 + np.exp(-np.clip(self.slope * d + self.bias, -40, 40)))


def discriminant(moments: dict[int, np.ndarray], pool: float, diagonal: float) -> Discriminant:
    """The densities from class moments: covariance = shrunk mix of the class's, the pooled and a
    multiple of the identity."""
    total = moments[0] + moments[1]
    n = total[0, 0]
    shift = total[0, 1:] / n
    scale = np.sqrt(np.maximum(np.diag(total)[1:] / n - shift ** 2, 1e-6))
    means, covariances, sizes = [], [], []
    for c in (0, 1):
        k = moments[c][0, 0]
        mean = moments[c][0, 1:] / k
        cov = (moments[c][1:, 1:] / k - np.outer(mean, mean)) / np.outer(scale, scale)
        means.append((mean - shift) / scale)
        covariances.append(cov)
        sizes.append(k)
    pooled = (sizes[0] * covariances[0] + sizes[1] * covariances[1]) / n
    factors, logdets = [], []
    for cov in covariances:
        mixed = (1 - pool) * cov + pool * pooled
        level = max(np.trace(mixed) / len(mixed), 1e-3)
        f = np.linalg.cholesky((1 - diagonal) * mixed + diagonal * level * np.eye(len(mixed)))
        factors.append(f)
        logdets.append(2 * float(np.log(np.diag(f)).sum()))
    return Discriminant(shift, scale, tuple(means), tuple(factors), tuple(logdets))


def fit_curve(centres: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> tuple[float, float, float]:
    """Slope (at least 0.001) and bias of a logistic curve on a histogram, and its mean loss."""
    slope, bias, n = 0.1, 0.0, ones + zeros
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * centres + bias, -40, 40)))
        g = np.array([(centres * (ones - n * p)).sum() - 1e-3 * slope, (ones - n * p).sum() - 1e-3 * bias])
        w = n * p * (1 - p)
        h = np.array([[(w * centres ** 2).sum() + 1e-2, (w * centres).sum()], [(w * centres).sum(), w.sum() + 1e-2]])
        step = np.clip(np.linalg.solve(h, g), -1.0, 1.0)
        slope, bias = max(slope + step[0], 1e-3), bias + step[1]
        if np.abs(step).max() < 1e-9:
            break
    t = np.clip(slope * centres + bias, -40, 40)
    loss = (ones * np.log1p(np.exp(-t)) + zeros * np.log1p(np.exp(t))).sum() / max(n.sum(), 1)
    return float(slope), float(bias), float(loss)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant | float:
    """The model of ``label`` from all labelled rows that are not held out; the share of ones (a half
    without labels) where one class has fewer than two training rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(vectors(b.column(0).to_pylist())), pa.list_(pa.float64())), b.column(1), b.column(2)],
                ["x", "y", "fold"])

    rows = materialize(labelled(docs, labels, label).select("text", "y", "fold")
                       .mapInArrow(run, "x array<double>, y int, fold long"), "quality-rows")
    counts = {(r["y"], r["fold"] == 1): r["n"] for r in
              rows.groupBy("y", (F.col("fold") == 1).alias("fold")).agg(F.count(F.lit(1)).alias("n"))
              .select("y", F.when(F.col("fold"), 1).otherwise(0).alias("fold"), "n").collect()}
    total = sum(counts.values())
    train, held = rows.where("fold <> 1"), rows.where("fold = 1")
    if min(counts.get((c, False), 0) for c in (0, 1)) < 2:
        train = rows
    if min(counts.get((c, True), 0) for c in (0, 1)) < 2:
        held = rows
    moments = class_moments(train)
    if min((moments[c][0, 0] if c in moments else 0) for c in (0, 1)) < 2:
        return sum(n for (y, _), n in counts.items() if y) / total if total else 0.5
    models = [discriminant(moments, p, d) for p in POOL for d in DIAGONAL]

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_counts = np.zeros((len(models), BINS, 2), dtype=np.int64)
        for b in batches:
            x, y = np.array(b.column(0).to_pylist(), dtype=float).reshape(-1, len(STATISTICS)), b.column(1).to_numpy()
            for i, m in enumerate(models):
                at = ((np.clip(m.difference(x), -SPAN, SPAN) + SPAN) / (2 * SPAN) * (BINS - 1)).round().astype(int)
                np.add.at(held_counts[i], (at, y), 1)
        i, bin_, c = np.nonzero(held_counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(bin_, pa.int32()), pa.array(c, pa.int32()),
             pa.array(held_counts[i, bin_, c])], ["m", "bin", "y", "n"])

    got = (held.select("x", "y").mapInArrow(histogram, "m int, bin int, y int, n long")
           .groupBy("m", "bin", "y").agg(F.sum("n").alias("n")).collect())  # models x bins x classes at most
    table = np.zeros((len(models), BINS, 2))
    for r in got:
        table[r["m"], r["bin"], r["y"]] = r["n"]
    centres = np.linspace(-SPAN, SPAN, BINS)
    curves = [fit_curve(centres, t[:, 1], t[:, 0]) for t in table]
    best = int(np.argmin([c[2] for c in curves]))
    model = models[best]
    model.slope, model.bias = curves[best][:2]
    return model


def score_column(model: Discriminant | float, text: str = "text") -> Column:
    if isinstance(model, float):
        return F.lit(model)

    @F.pandas_udf("double")
    def score(t: pd.Series) -> pd.Series:
        return pd.Series(model.scores(vectors(t.to_list())))

    return score(F.col(text))


def quality_digest(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; null text scores as empty, a null doc_id is
    not held out; rows that repeat score alike; an empty table gives no rows."""
    model = fit(docs, labels)
    return (docs.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
                        score_column(model).alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
