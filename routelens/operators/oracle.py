"""Oracle labelling: the cheapest among the best models of each prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelens.constants import NO_MODEL_CORRECT, ORACLE


def oracle_label(long_df: DataFrame, keys: tuple = ("sample_id", "eval_name"), keep: tuple = ()) -> DataFrame:
    """Per prompt: the model with the top performance, cheapest on ties, then lowest index.

    A single aggregate with map-side partial aggregation (sort-based, since the
    buffer is a struct; spill-safe): ``min`` over
    ``struct(-performance, cost unknown?, cost, model_idx, model)`` is the arg-max of
    performance with the tie-breaks (cheaper, then lower index; unknown cost last), and ``max`` decides whether any
    model earned credit (max > 0, else ``no_model_correct``).  Rows with a NULL
    performance do not compete; NaN must be turned to NULL on ingest.  ``keep``: named aggregates of the
    prompt's rows that are returned beside the label.
    """
    perf = F.col("performance")
    # an unknown cost loses ties (sorts after every known cost)
    cand = F.when(perf.isNotNull(), F.struct((-perf).alias("neg_perf"), F.col("cost_pico").isNull().alias("no_cost"),
                                             F.col("cost_pico").alias("cost"), F.col("model_idx").alias("idx"),
                                             F.col("model").alias("model")))
    agg = long_df.groupBy(*keys).agg(F.max(perf).alias("_mx"), F.min(cand).alias("_best"), *keep)
    ok = F.col("_mx") > 0
    return agg.select(
        *keys,
        F.when(ok, F.col("_best.model")).otherwise(F.lit(NO_MODEL_CORRECT)).alias(ORACLE),
        F.when(ok, -F.col("_best.neg_perf")).otherwise(F.lit(0.0)).alias("oracle_performance"),
        F.when(ok, F.col("_best.cost")).otherwise(F.lit(0).cast("long")).alias("oracle_cost_pico"),
        *[c for c in agg.columns if c not in (*keys, "_mx", "_best")],
    )


def fill_performance(long_df: DataFrame) -> DataFrame:
    """NULL performance -> 0.0 (applied after the oracle label, which skips NULLs)."""
    return long_df.withColumn("performance", F.coalesce(F.col("performance"), F.lit(0.0)))
