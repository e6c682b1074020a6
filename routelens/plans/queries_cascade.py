"""Registered queries: acceptance thresholds and the cascade simulation."""

from __future__ import annotations

from pyspark.sql import functions as F

from routelens.operators.cascade import accept_thresholds, cascade_results, order_chains, simulate
from routelens.functions.text import n_tokens_all
from routelens.operators.oracle import fill_performance
from routelens.operators.reshape import drop_null_rows, to_answers
from routelens.operators.routing import price_vectors
from routelens.plans.registry import as_long, query
from routelens.session import materialize
from routelens.sources.fixtures import N_MODELS, eval_long, model_price


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def cascade_run(spark, sf_dir):
    el = drop_null_rows(fill_performance(eval_long(spark, sf_dir)), ["performance", "cost_pico", "response"])
    # five passes read these answers (threshold bracket, counts, band, lengths, chains): write the
    # needed columns once in the shared folder instead of re-deriving them per pass
    el = materialize(el.select("eval_name", "sample_id", "model", "model_idx", "performance", "cost_pico",
                               n_tokens_all(F.col("response")).alias("response_tokens")), "cascade-answers")
    thr = accept_thresholds(el)
    lengths = el.groupBy("eval_name", "model", "model_idx").agg(F.avg("response_tokens").alias("avg_response_tokens"))
    price = price_vectors(model_price(spark), lengths, N_MODELS, ["eval_name"])
    chains = order_chains(to_answers(el), price, thr)
    return cascade_results(simulate(chains))


@query("q_accept_threshold")
def q_accept_threshold(spark, sf_dir):
    el = fill_performance(eval_long(spark, sf_dir))
    return accept_thresholds(el).select("eval_name", r6("threshold").alias("threshold"))


@query("q_cascade")
def q_cascade(spark, sf_dir):
    r = cascade_run(spark, sf_dir)
    return r.select("eval_name", "max_cost_per_response", "evaluator_error_rate",
                    r6("performance_threshold").alias("performance_threshold"),
                    r6("performance").alias("performance"), as_long("total_cost_pico"))


@query("q_cascade_grid")
def q_cascade_grid(spark, sf_dir):
    r = cascade_run(spark, sf_dir)
    g = r.groupBy("max_cost_per_response", "evaluator_error_rate").agg(
        F.avg("performance").alias("performance"), F.sum("total_cost_pico").alias("total_cost_pico"),
        F.count(F.lit(1)).alias("n_evals"))
    return g.select("max_cost_per_response", "evaluator_error_rate", r6("performance").alias("performance"),
                    as_long("total_cost_pico"), "n_evals")


@query("q_cascade_series")
def q_cascade_series(spark, sf_dir):
    """Plot series of the cascade: its variant at judge error rate 0.2, one point per budget."""
    r = cascade_run(spark, sf_dir).where(F.col("evaluator_error_rate") == 0.2)
    return r.select("eval_name", "max_cost_per_response", as_long("total_cost_pico"), r6("performance").alias("performance"))
