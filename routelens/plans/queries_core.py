"""Registered queries: pricing, oracle and baseline scores (the minimum slice)."""

from __future__ import annotations

from pyspark.sql import functions as F

from routelens.operators.cost import price_answers, response_length
from routelens.operators.oracle import fill_performance, oracle_label
from routelens.operators.scores import eval_scores, oracle_scores
from routelens.plans.registry import as_long, query
from routelens.sources.fixtures import eval_long, model_price
from routelens.functions.text import n_tokens, n_tokens_all
from routelens.sources.tables import read_table


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _once(c):
    """A prompt's own value, worked out on its first model's row alone."""
    return F.first(F.when(F.col("model_idx") == 0, c), ignorenulls=True)


@query("q_token_cost")
def q_token_cost(spark, sf_dir):
    el = eval_long(spark, sf_dir).drop("cost_pico")
    # one row per prompt (answers bounded by the number of models), prompt tokens counted once; the texts
    # are counted where they are read, counts alone move
    samples = el.groupBy("sample_id").agg(_once(n_tokens_all("prompt")).alias("prompt"), F.collect_list(
        F.struct("model", "model_idx", n_tokens_all("response").alias("response"))).alias("answers"))
    return price_answers(samples, model_price(spark)).select("sample_id", "model", "cost_pico")


@query("q_token_count")
def q_token_count(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", n_tokens(F.col("text")).alias("n_tokens"))


@query("q_oracle_label")
def q_oracle_label(spark, sf_dir):
    return oracle_label(eval_long(spark, sf_dir)).select(
        "sample_id", "eval_name", "oracle", r6("oracle_performance").alias("oracle_performance"),
        "oracle_cost_pico")


@query("q_oracle_scores")
def q_oracle_scores(spark, sf_dir):
    s = oracle_scores(eval_long(spark, sf_dir))
    return s.select("eval_name", "model", r6("performance").alias("performance"), as_long("total_cost_pico"))


@query("q_eval_scores")
def q_eval_scores(spark, sf_dir):
    s = eval_scores(eval_long(spark, sf_dir))
    return s.select("eval_name", "model", r6("performance").alias("performance"), as_long("total_cost_pico"))


@query("q_fill_performance")
def q_fill_performance(spark, sf_dir):
    el = eval_long(spark, sf_dir)
    lab = oracle_label(el).select("sample_id", "oracle")
    return fill_performance(el).join(lab, "sample_id").select("sample_id", "model", "performance", "oracle")


@query("q_response_length")
def q_response_length(spark, sf_dir):
    rl = response_length(eval_long(spark, sf_dir))
    return rl.select("model", r6("avg_response_tokens").alias("avg_response_tokens"))
