"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target / source size.  Its copies
are the integer boundaries that the running sum of expected copies, moved by one random offset per
source, crosses at the document: a document gets the rounded-down or rounded-up expectation, and any
run of documents gets its expected total to within one.  Documents are ordered by size class, so the
words taken also come near the target: the error is about one document of each class.

Only DataFrame functions.  The running sum needs ranks within a source that may hold a third of all
rows; :func:`routelens.llm.common.spread_rank` numbers them without a task that sees a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routelens.llm.common import WORD, as_row, small_side, spread_rank
from routelens.session import materialize

WEIGHTS = (5, 2, 1)
CAP = 3


def md5_number(digits: int, *parts) -> Column:
    """The first hexadecimal digits of the parts' MD5 as a number; any SQL engine can follow it."""
    joined = F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, digits), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Target words of each source: (source, source_size) -> and (position, target).

    Sources in code-point order, null last, weigh ``weights`` in turn.  Targets share the total by
    weight, none above ``cap`` times its source; excess is reshared.  Closed form of the resharing:
    with sources ordered by cap / weight, the level "what is left / weights left" rises while sources
    fill up and falls afterwards, so its maximum is the final words per unit of weight.
    One row per source: the unpartitioned windows see source totals only, never documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy(F.col("full") / F.col("weight"), "position")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("position") - 1) % len(weights) + 1))
    return (sizes.withColumn("position", F.row_number().over(by_name))
            .withColumn("weight", w)
            .withColumn("full", F.col("source_size") * F.lit(float(cap)))
            .withColumn("total", F.sum(F.col("source_size").cast("double")).over(Window.partitionBy()))
            .withColumn("filled", F.coalesce(
                F.sum("full").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
            .withColumn("left", F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
            .withColumn("level", F.max((F.col("total") - F.col("filled")) / F.col("left")).over(Window.partitionBy()))
            .withColumn("target", F.least("full", F.col("level") * F.col("weight")))
            .select("source", "source_size", "position", "target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 1, whole: bool = True) -> DataFrame:
    """Copies of each row of ``docs`` (doc_id, text, source and any other columns).

    Returns ``__row`` (the input row as a struct; its doc_id alone unless ``whole``, and then texts are read
    once and never shuffled), size, source_size, target and copies (long).
    Null text has size 0; null source is a source of its own; documents of size 0 get copies like any
    other and take no words; a repeated row is a document of its own; an empty table gives no rows.
    Equal input gives equal output, whatever the partitioning.
    """
    text = F.coalesce(F.col("__row.text"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    # eight size classes to each doubling: the number of binary digits, then the first four of them
    digits = F.length(F.bin("size"))
    bucket = digits * 16 + F.expr("shiftright(size * 16, length(bin(size)))").cast("int")
    rows = (as_row(docs)
            .select("__row", size.alias("size"), F.col("__row.source").alias("source"),
                    (md5_number(15, F.lit(str(seed)), "__row.doc_id", "__row.text") * 8).alias("h"))
            .withColumn("bucket", bucket))
    slim = materialize(rows.select("source", "size", "bucket", "h", F.struct("__row.doc_id").alias("__row")), "mix-slim")
    rows = rows if whole else slim
    targets = materialize(source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")),
                                         weights, cap), "mix-targets")
    t = targets.select(F.col("source").alias("s0"), F.col("position").alias("key"), "source_size", "target")
    t = small_side(t, 100)

    def keyed(x: DataFrame) -> DataFrame:
        return x.join(t, F.col("source").eqNullSafe(F.col("s0"))).drop("s0", "source")

    ranked = spread_rank(keyed(rows).withColumn("tie", F.col("__row.doc_id")),
                         keyed(slim).select("key", "bucket", "h"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # offsets on a grid of 1/1024: sums with whole numbers stay exact, so a rate of 3 gives 3 copies
    offset = (md5_number(3, F.lit(f"{seed}|offset"), "key") % 1024 + 0.5) / 1024
    crossed = (F.floor(rate * (F.col("rank") + 1) + offset) - F.floor(rate * F.col("rank") + offset))
    return ranked.select("__row", "size", "source_size", "target",
                         F.least(crossed, F.ceil(rate)).cast("long").alias("copies"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 1) -> DataFrame:
    """The mixed corpus: every row of ``docs`` once per copy, with the columns of ``docs``.  Nulls, empty
    texts, repeated rows and empty tables as in :func:`mix`; very long texts are rows like any other."""
    out = mix(docs, weights, cap, seed).where("copies > 0")
    return (out.select("__row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("__copy"))
            .select("__row.*"))


def mix_digest(docs: DataFrame, **params) -> DataFrame:
    return mix(docs, whole=False, **params).select("__row.doc_id", "size", "source_size", "target",
                                      (F.col("size") * F.col("copies")).alias("taken"))
