"""Operations on the long ``eval_results`` table: unions, pivots, macro means, best variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routelens.constants import DISPLAY_NAMES, ORACLE


def union_results(frames: list[DataFrame]) -> DataFrame:
    """Union of result tables whose parameter columns differ, then distinct rows."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.distinct()


def mark_baselines(results: DataFrame, models: list[str], router_col: str = "router") -> DataFrame:
    """Flag LLM and oracle rows (``is_baseline``) so every router is compared with them."""
    return results.withColumn("is_baseline", F.col(router_col).isin(*(list(models) + [ORACLE])))


def macro_mean(results: DataFrame, variant_cols: list[str]) -> DataFrame:
    """Unweighted mean over evals: one row per (eval, variant) first, then the mean per variant."""
    per_eval = results.groupBy("eval_name", *variant_cols).agg(F.avg("performance").alias("performance"),
                                                              F.avg("total_cost").alias("total_cost"))
    return per_eval.groupBy(*variant_cols).agg(F.avg("performance").alias("performance"),
                                               F.avg("total_cost").alias("total_cost"),
                                               F.count(F.lit(1)).alias("n_evals"))


def best_point_per_variant(results: DataFrame, variant_cols: list[str], order_col: str = "willingness_to_pay"):
    """Over rising wtp, the first point with the highest performance of each (eval, variant).

    A variant that never scores above 0 keeps its cheapest cost.
    """
    key = ["eval_name"] + variant_cols
    w = Window.partitionBy(*key).orderBy(F.col("performance").desc_nulls_last(), F.col(order_col).asc_nulls_last())
    wall = Window.partitionBy(*key)
    r = results.withColumn("_rn", F.row_number().over(w)).withColumn("_minc", F.min("total_cost").over(wall))
    r = r.where(F.col("_rn") == 1)
    return r.select(*key, "performance",
                    F.when(F.col("performance") > 0, F.col("total_cost")).otherwise(F.col("_minc")).alias("total_cost"),
                    F.col(order_col).alias(f"best_{order_col}"))


def best_variant(results: DataFrame, variant_cols: list[str], within: list[str]) -> DataFrame:
    """Per eval and ``within`` group (e.g. embedding): the variant with the best point,
    highest performance first, then lowest cost, then variant order."""
    b = best_point_per_variant(results, variant_cols + [c for c in within if c not in variant_cols])
    w = Window.partitionBy("eval_name", *within).orderBy(F.col("performance").desc_nulls_last(),
                                                          F.col("total_cost").asc_nulls_last(),
                                                          *[F.col(c).asc_nulls_last() for c in variant_cols])
    return b.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def family_series(points: DataFrame, cascade: DataFrame, variant_cols: list[str], skip: tuple = ("svm",),
                  error_rate: float = 0.2) -> DataFrame:
    """Plot series per eval: all points of each router family's best variant (``variant_cols`` begin with
    ``router``; families in ``skip`` are not plotted) by willingness to pay, and the cascade's points at one
    judge error rate by budget.  Equal variants' rows all stay; NULL parameters match NULL."""
    best = best_variant(points.where(~F.col("router").isin(*skip)), variant_cols, ["router"]).select(
        "eval_name", *[F.col(c).alias(f"_{c}") for c in variant_cols])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in variant_cols]
    series = points.join(best.withColumnRenamed("eval_name", "_eval"),
                         [F.col("eval_name") == F.col("_eval"), *same], "left_semi")
    cols = ["eval_name", *variant_cols, "x_value", "total_cost", "performance"]
    asked = cascade.where(F.col("evaluator_error_rate") == error_rate)
    return (series.withColumn("x_value", F.col("willingness_to_pay")).select(*cols)
            .unionByName(asked.withColumn("x_value", F.col("max_cost_per_response")).select(*cols)))


def display_names(spark) -> DataFrame:
    return spark.createDataFrame(DISPLAY_NAMES, "model string, display_name string")


def with_display_name(df: DataFrame, names: DataFrame, col: str = "model") -> DataFrame:
    """Display label per model, the raw name when unknown (left join on a fixed 20-row table)."""
    n = names.withColumnRenamed("model", col)
    return df.join(F.broadcast(n), col, "left").withColumn(
        "display_name", F.coalesce(F.col("display_name"), F.col(col)))


def results_wide(results: DataFrame, names: list[str], name_col: str = "model") -> DataFrame:
    """One row per eval; columns ``<name>_performance`` and ``<name>_total_cost`` (mean over rows)."""
    return results.groupBy("eval_name").pivot(name_col, names).agg(
        F.avg("performance").alias("performance"), F.avg("total_cost").alias("total_cost"))


def plot_points(router_results: DataFrame, llm_results: DataFrame, prefix: str | None,
                variant_cols: list[str], x_col: str = "willingness_to_pay") -> DataFrame:
    """Plotting data of an eval family (or of all evals when ``prefix`` is None): every router
    variant's points along ``x_col`` and every model's point, each the unweighted mean over the
    family's evals.  Rows ``(series, x_value, total_cost, performance)``; models have NULL x."""
    def fam(df):
        return df if prefix is None else df.where(F.col("eval_name").startswith(prefix))
    name = F.concat_ws("|", *[F.col(c).cast("string") for c in variant_cols])
    r = fam(router_results).groupBy(*variant_cols, x_col).agg(F.avg("performance").alias("performance"),
                                                             F.avg("total_cost").alias("total_cost"))
    r = r.select(name.alias("series"), F.col(x_col).cast("double").alias("x_value"), "total_cost", "performance")
    m = fam(llm_results).groupBy("model").agg(F.avg("performance").alias("performance"),
                                              F.avg("total_cost").alias("total_cost"))
    m = m.select(F.col("model").alias("series"), F.lit(None).cast("double").alias("x_value"), "total_cost",
                 "performance")
    return r.unionByName(m)


def results_wide_by_variant(results: DataFrame, name: F.Column, names: list[str]) -> DataFrame:
    """One row per eval with a column per ``<variant name>|<measure>`` (measures: performance,
    total_cost), the mean over rows: the two measures are melted with a generator and pivoted
    on the explicit name list (no extra job to discover the names)."""
    melted = results.select("eval_name", name.alias("_name"), F.inline(F.array(
        F.struct(F.lit("performance").alias("_measure"), F.col("performance").cast("double").alias("_value")),
        F.struct(F.lit("total_cost").alias("_measure"), F.col("total_cost").cast("double").alias("_value")))))
    melted = melted.select("eval_name", F.concat_ws("|", "_name", "_measure").alias("_col"), "_value")
    cols = [f"{n}|{m}" for n in names for m in ("performance", "total_cost")]
    return melted.groupBy("eval_name").pivot("_col", cols).agg(F.avg("_value"))
