"""Per-eval scores of models, the oracle and routers (mean performance, summed cost)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelens.constants import MONEY, ORACLE
from routelens.operators.oracle import oracle_label


def model_scores(long_df: DataFrame, by: tuple = ("eval_name", "model")) -> DataFrame:
    """Mean performance and total pico-USD cost per group; partial aggregation map-side."""
    return long_df.groupBy(*by).agg(F.avg("performance").alias("performance"),
                                    F.sum(F.col("cost_pico").cast(MONEY)).alias("total_cost_pico"))


def oracle_scores(long_df: DataFrame) -> DataFrame:
    """Per eval: mean performance and total cost of always choosing the oracle label."""
    lab = oracle_label(long_df)
    return lab.groupBy("eval_name").agg(
        F.avg("oracle_performance").alias("performance"),
        F.sum(F.col("oracle_cost_pico").cast(MONEY)).alias("total_cost_pico")).select(
        "eval_name", F.lit(ORACLE).alias("model"), "performance", "total_cost_pico")


def eval_scores(long_df: DataFrame, keys: tuple = ("sample_id", "eval_name")) -> DataFrame:
    """Baseline table: every model (NULL performance counted as 0) plus the oracle, per eval.

    The answers are read once: one aggregate per prompt (key: ``keys``) gives its oracle choice beside the
    models' grades and costs, which are then averaged and summed with map-side partial sums.
    """
    labelled = oracle_label(long_df, keys=keys, keep=(F.collect_list(F.struct(
        "model", F.coalesce("performance", F.lit(0.0)).alias("performance"), "cost_pico")).alias("_answers"),))
    chosen = F.struct(F.lit(ORACLE).alias("model"), F.col("oracle_performance").alias("performance"),
                      F.col("oracle_cost_pico").alias("cost_pico"))
    rows = labelled.select("eval_name", F.explode(F.concat("_answers", F.array(chosen))).alias("_a"))
    return model_scores(rows.select("eval_name", "_a.*"))
