"""Registered queries: nearest neighbours, neighbour scores, wtp routing and router scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from routelens.constants import KNN_NEIGHBORS, WTP_GRID, WTP_TEXT
from routelens.functions.variants import variant_name
from routelens.operators.split import families
from routelens.plans.evaluate import (baseline_results, eval_results, family_prices, knn_neighbors, knn_routed,
                                      knn_results, knn_scores, prepare)
from routelens.plans.registry import as_long, query
from routelens.sources.fixtures import N_MODELS, eval_long, model_price, router_vectors
from routelens.sources.tables import read_table


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _rd(spark, sf_dir, **options):
    return prepare(eval_long(spark, sf_dir), N_MODELS, vectors=router_vectors(spark, sf_dir), **options)


@query("q_knn_neighbors")
def q_knn_neighbors(spark, sf_dir):
    return _neighbors(spark, sf_dir, "cosine")


def _neighbors(spark, sf_dir, metric, digits=6):
    nb = knn_neighbors(_rd(spark, sf_dir, answers=False), max(KNN_NEIGHBORS), metric)
    return nb.select("family", F.col("query_id").alias("sample_id"), "neighbor_id", F.round("sim", digits).alias("sim"),
                     F.col("rank").cast("long").alias("rank"))


@query("q_knn_euclidean")
def q_knn_euclidean(spark, sf_dir):
    return _neighbors(spark, sf_dir, "euclidean", 4)


@query("q_knn_manhattan")
def q_knn_manhattan(spark, sf_dir):
    return _neighbors(spark, sf_dir, "manhattan", 4)


@query("q_knn_scores")
def q_knn_scores(spark, sf_dir):
    sc = knn_scores(_rd(spark, sf_dir, answers=False))
    x = sc.select("family", F.col("k").cast("int").alias("neighbors"), F.col("query_id").alias("sample_id"),
                  F.posexplode("scores").alias("model_idx", "score"))
    return x.select("family", "neighbors", "sample_id", "model_idx", r6("score").alias("score"))


@query("q_price_score")
def q_price_score(spark, sf_dir):
    pv = family_prices(_rd(spark, sf_dir), model_price(spark))
    x = pv.select("family", F.posexplode("price").alias("model_idx", "p"))
    return x.select("family", "model_idx", r6(F.col("p") * F.lit(1e12)).alias("price_score_pico"))


@query("q_route_knn")
def q_route_knn(spark, sf_dir):
    r = knn_routed(_rd(spark, sf_dir), model_price(spark))
    return r.select(F.col("k").cast("int").alias("neighbors"), "wtp", F.col("query_id").alias("sample_id"),
                    "chosen")


@query("q_route_lookup")
def q_route_lookup(spark, sf_dir):
    r = knn_routed(_rd(spark, sf_dir), model_price(spark))
    return r.select(F.col("k").cast("int").alias("neighbors"), "wtp", F.col("query_id").alias("sample_id"),
                    "chosen", "performance", "cost_pico")


@query("q_wtp_sweep")
def q_wtp_sweep(spark, sf_dir):
    r = knn_results(_rd(spark, sf_dir), model_price(spark))
    return r.select("eval_name", "neighbors", "wtp", r6("performance").alias("performance"), as_long("total_cost_pico"))


@query("q_knn_grid")
def q_knn_grid(spark, sf_dir):
    r = knn_results(_rd(spark, sf_dir), model_price(spark))
    wtp_text = F.element_at(F.create_map(*[x for w, t in zip(WTP_GRID, WTP_TEXT) for x in (F.lit(w), F.lit(t))]),
                            F.col("wtp"))
    name = variant_name("knn", [("neighbors", F.col("neighbors").cast("string")), ("metric", F.col("metric")),
                                ("embedding", F.col("embedding")), ("fraction", F.lit("0.7")),
                                ("willingness_to_pay", wtp_text)])
    return r.select("eval_name", name.alias("variant"), r6("performance").alias("performance"), as_long("total_cost_pico"))


@query("q_router_scores")
def q_router_scores(spark, sf_dir):
    r = eval_results(_rd(spark, sf_dir), model_price(spark))
    return r.select("eval_name", "router", "neighbors", "wtp", r6("performance").alias("performance"),
                    as_long("total_cost_pico"))


@query("q_test_baselines")
def q_test_baselines(spark, sf_dir):
    r = baseline_results(_rd(spark, sf_dir, tokens=False))
    return r.select("eval_name", "router", r6("performance").alias("performance"), as_long("total_cost_pico"))


@query("q_route_knn_ood")
def q_route_knn_ood(spark, sf_dir):
    """kNN routing out of distribution: neighbours come from the other families' train parts,
    queries are the test part of the wanted family, for every family."""
    wanted = families(read_table(spark, sf_dir, "documents"), "lang")
    r = knn_routed(_rd(spark, sf_dir, ood_wanted=wanted), model_price(spark))
    return r.select("family", F.col("k").cast("int").alias("neighbors"), "wtp", F.col("query_id").alias("sample_id"),
                    "chosen", "performance", "cost_pico")


@query("q_wtp_sweep_sources")
def q_wtp_sweep_sources(spark, sf_dir):
    """kNN sweep with the source-group split (whole sources on one side)."""
    r = knn_results(_rd(spark, sf_dir, split_by="source"), model_price(spark))
    return r.select("eval_name", "neighbors", "wtp", r6("performance").alias("performance"), as_long("total_cost_pico"))
