"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelens.llm.common import small_side
from routelens.session import materialize


def _lowest(pairs: DataFrame, name: str) -> DataFrame:
    """(n0, low): each node and the smallest of its neighbours and itself; written, so that the join
    below can broadcast it if it is small and split a hot node if it is not."""
    low = (pairs.groupBy(F.col("u").alias("n0")).agg(F.min("v").alias("v"))
           .select("n0", F.least("n0", "v").alias("low")))
    return small_side(materialize(low, name), 32)


def star_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long, not null, any order, repeats allowed)
    but the roots; a root is the smallest node of its component.

    Each round costs a few shuffles of the edges and writes them below the shared folder, which cuts
    the lineage; the number of rounds grows with the logarithm of the longest path.  Minima are
    pre-aggregated, so a hub is one row per task.
    """
    current = materialize(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    mark = None
    while True:
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            current.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = (both.join(_lowest(both, "cc-large"), F.col("u") == F.col("n0")).where("v > u")
                 .select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct())
        large = materialize(large, "cc-stars")
        small = large.join(_lowest(large, "cc-small"), F.col("u") == F.col("n0"))
        pairs = F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("low").alias("b")),
                                  F.struct(F.col("u").alias("a"), F.col("low").alias("b"))))
        current = materialize(small.select(pairs.alias("e")).select("e.a", "e.b").where("a <> b").distinct(), "cc-edges")
        new = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if new == mark:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = new
