"""Registered queries: SVR-style and MLP-style routers and the full evaluation table
(rows-only checks: the fits are iterative).

Every eval family gets its own predictors (in-distribution routing), but all
families are fitted together: one distributed pass per solver round.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from routelens.plans.evaluate import evaluate_all, mlp_results, prepare, svr_results
from routelens.plans.registry import query
from routelens.sources.fixtures import N_MODELS, eval_long, model_price, router_vectors


def _rd(spark, sf_dir):
    return prepare(eval_long(spark, sf_dir), N_MODELS, vectors=router_vectors(spark, sf_dir))


def _r6(df):
    return df.withColumn("performance", F.round("performance", 6))


@query("q_route_svr")
def q_route_svr(spark, sf_dir):
    return _r6(svr_results(_rd(spark, sf_dir), model_price(spark)))


@query("q_route_mlp")
def q_route_mlp(spark, sf_dir):
    return _r6(mlp_results(_rd(spark, sf_dir), model_price(spark)))


@query("q_evaluate_all")
def q_evaluate_all(spark, sf_dir):
    return _r6(evaluate_all(_rd(spark, sf_dir), model_price(spark)))
