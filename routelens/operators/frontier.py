"""Cost/quality frontier: non-decreasing convex hull (NDCH) and its normalised area (AIQ).

A frontier group is one router variant's points (one per wtp or budget value),
so its size is bounded by the configuration grid.  Points of a group are
gathered into one sorted array and the upper hull is built by a monotone-chain
fold (``aggregate``) -- linear per group, no pairwise rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _cross(o, a, b):
    """(a - o) x (b - o): >= 0 means a is on or below the chord o -> b."""
    return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])


def _from2(n: F.Column) -> F.Column:
    """[2, 3, ..., n] (empty when n < 2)."""
    return F.when(n >= 2, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))


def upper_hull(pts: F.Column) -> F.Column:
    """Upper convex hull of an x-sorted array of struct(x, y) with distinct x (collinear points dropped)."""
    empty = F.array().cast("array<struct<x:double,y:double>>")

    def push(stack, p):
        n = F.size(stack)
        # how many stack entries survive: the right-turn test is monotone along a concave chain
        keep_idx = F.filter(_from2(n),
                            lambda i: _cross(F.element_at(stack, i - 1), F.element_at(stack, i), p) < 0)
        m = F.when(n == 0, F.lit(0)).otherwise(F.least(n, F.lit(1) + F.size(keep_idx)))
        kept = F.when(m == 0, empty).otherwise(F.slice(stack, F.lit(1), m))
        return F.concat(kept, F.array(F.struct(p["x"].alias("x"), p["y"].alias("y"))))

    return F.aggregate(pts, empty, push)


def non_decreasing(hull: F.Column) -> F.Column:
    """The rising part of a concave hull: vertices whose y is not below the previous vertex."""
    return F.filter(hull, lambda v, i: F.when(i == 0, F.lit(True)).otherwise(v["y"] >= F.element_at(hull, i)["y"]))


def ndch(points: DataFrame, group_cols: list[str], x: str = "total_cost", y: str = "performance") -> DataFrame:
    """``(group..., hull array<struct<x, y>>, n_points)`` per group.

    Equal x collapse to their largest y first; 1 or 2 points are their own hull.
    ``n_points`` counts distinct raw (x, y) pairs (the AIQ qualification rule).
    """
    p = points.select(*group_cols, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(
        F.col("x").isNotNull() & F.col("y").isNotNull())
    n = p.groupBy(*group_cols).agg(F.count_distinct("x", "y").alias("n_points"))
    c = p.groupBy(*group_cols, "x").agg(F.max("y").alias("y"))
    arr = c.groupBy(*group_cols).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("pts"))
    h = arr.select(*group_cols, non_decreasing(upper_hull(F.col("pts"))).alias("hull"))
    return h.join(n, group_cols)


def area(hull: F.Column) -> F.Column:
    """Trapezoid area under a polyline given as x-sorted struct(x, y) array."""
    seg = F.transform(_from2(F.size(hull)), lambda i: (
        (F.element_at(hull, i)["x"] - F.element_at(hull, i - 1)["x"])
        * (F.element_at(hull, i)["y"] + F.element_at(hull, i - 1)["y"]) / F.lit(2.0)))
    return F.aggregate(seg, F.lit(0.0), lambda a, b: a + b)


def aiq(points: DataFrame, compare_cols: list[str], variant_cols: list[str], x: str = "total_cost",
        y: str = "performance", min_points: int = 3) -> DataFrame:
    """AIQ of every qualifying variant among the variants compared together.

    Variants with fewer than ``min_points`` distinct (x, y) points are excluded.
    Each hull is held flat from its last vertex to the largest hull x among the
    compared variants; area / that x is the AIQ (NULL when it is 0).
    """
    h = ndch(points, compare_cols + variant_cols, x, y).where(F.col("n_points") >= min_points)
    last = F.element_at(F.col("hull"), -1)
    h = h.select(*compare_cols, *variant_cols, "hull", last["x"].alias("last_x"), last["y"].alias("last_y"))
    w = Window.partitionBy(*compare_cols)
    h = h.withColumn("max_x", F.max("last_x").over(w))
    total = area(F.col("hull")) + (F.col("max_x") - F.col("last_x")) * F.col("last_y")
    return h.select(*compare_cols, *variant_cols, F.try_divide(total, F.col("max_x")).alias("aiq"))


def aiq_ranking(aiqs: DataFrame, variant_cols: list[str]) -> DataFrame:
    """Mean AIQ per variant over the evals where it qualifies, with that count, best first
    (a distributed sort; no single-task global window)."""
    g = aiqs.groupBy(*variant_cols).agg(F.avg("aiq").alias("mean_aiq"), F.count(F.lit(1)).alias("n_evals"))
    return g.orderBy(F.col("mean_aiq").desc(), *variant_cols)
