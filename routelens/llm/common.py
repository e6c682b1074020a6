"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of every text contract here: space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

BROADCAST_BYTES = 32 << 20
BATCH_ROWS = 500


def small_side(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows stay below ``limit`` bytes, else ``df`` as it
    is, so that the join is planned as a shuffle.  ``df`` should be cheap to count (a written table)."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def bounded_batches(df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """``df``, after lowering the session's Arrow batch to ``rows`` rows: whole texts travel to Python in
    batches counted in rows, and the default of 10,000 could be gigabytes of long texts."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(key)) > rows or int(conf.get(key)) <= 0:
        conf.set(key, rows)
    return df


@contextmanager
def batch_rows(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the jobs that run inside the block; the session's own
    setting comes back afterwards.  For passes over whole texts or wide rows that are written at once."""
    conf, key = spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, rows if int(before) <= 0 else min(rows, int(before)))
    try:
        yield
    finally:
        conf.set(key, before)


def as_row(df: DataFrame, name: str = "__row") -> DataFrame:
    """All columns of ``df`` packed into one struct, so that helper columns can't clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def hash63(*cols) -> Column:
    """A hash of the columns from 0 to 2^63 - 1."""
    return F.xxhash64(*cols).bitwiseAND(F.lit((1 << 63) - 1))


def spread_rank(df: DataFrame, slim: DataFrame, cell_rows: int = 256, max_cells: int = 65536) -> DataFrame:
    """Adds ``rank`` (long, from 0): the place of each row among the rows of its ``key`` in the order
    (bucket, h, tie), where ``h`` is a hash from 0 to 2^63 - 1.

    No key is ranked in one task: the hash range of a (key, bucket) is cut into cells of about
    ``cell_rows`` rows, rows are numbered inside their cell, and a prefix sum over the cell counts (at
    most buckets x ``max_cells`` rows a key) gives the rows before each cell.  The result depends on
    the rows alone, not on how they are partitioned.  ``slim`` holds (key, bucket, h) of the same rows
    (a written table, read three times); ``df`` holds key, bucket, h, tie and anything else.
    """
    sizes = small_side(
        slim.groupBy(F.col("key").alias("k0"), F.col("bucket").alias("b0"))
        .agg(F.least(F.lit(max_cells), F.ceil(F.count(F.lit(1)) / cell_rows)).cast("long").alias("cells")), 40)

    def in_cell(rows: DataFrame) -> DataFrame:
        on = (F.col("key") == F.col("k0")) & (F.col("bucket") == F.col("b0"))
        cell = F.shiftright(F.shiftright("h", 32) * F.col("cells"), 31)
        return rows.join(sizes, on).withColumn("cell", cell).drop("k0", "b0", "cells")

    before = Window.partitionBy("k1").orderBy("b1", "c1").rowsBetween(Window.unboundedPreceding, -1)
    counts = (in_cell(slim).groupBy(F.col("key").alias("k1"), F.col("bucket").alias("b1"), F.col("cell").alias("c1"))
              .agg(F.count(F.lit(1)).alias("in_cell"))
              .withColumn("before", F.coalesce(F.sum("in_cell").over(before), F.lit(0))).drop("in_cell"))
    inside = Window.partitionBy("key", "bucket", "cell").orderBy("h", "tie")
    on = (F.col("key") == F.col("k1")) & (F.col("bucket") == F.col("b1")) & (F.col("cell") == F.col("c1"))
    return (in_cell(df).join(counts, on)
            .withColumn("rank", F.col("before") + F.row_number().over(inside) - 1)
            .drop("k1", "b1", "c1", "cell", "before"))
