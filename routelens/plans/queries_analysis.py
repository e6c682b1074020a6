"""Registered queries: analysis of results (means, best variants, frontier, AIQ, names, sinks)."""

from __future__ import annotations

from pyspark.sql import functions as F

from routelens.constants import WTP_GRID, WTP_TEXT
from routelens.functions.variants import parse_params_tolerant, parse_variant, variant_name
from routelens.operators.frontier import aiq, aiq_ranking, ndch
from routelens.operators.results import (best_variant, display_names, family_series, macro_mean, mark_baselines, plot_points,
                                         results_wide, results_wide_by_variant, union_results, with_display_name)
from routelens.operators.scores import eval_scores
from routelens.plans.registry import as_long, query
from routelens.session import scratch_path
from routelens.sources.results_io import load_results, save_results
from routelens.sources.fixtures import eval_long, fixture_variant_names, variant_results

MODELS = [f"m{i}" for i in range(5)]


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _vr(spark, sf_dir):
    return variant_results(spark, sf_dir)


def _scores(spark, sf_dir):
    s = eval_scores(eval_long(spark, sf_dir))
    return s.select("eval_name", "model", "performance", as_long("total_cost_pico").alias("total_cost"))


def _wtp_text():
    return F.element_at(F.create_map(*[x for w, t in zip(WTP_GRID, WTP_TEXT) for x in (F.lit(w), F.lit(t))]),
                        F.col("willingness_to_pay"))


def _name(with_wtp=True, value_type=None):
    params = [("neighbors", F.col("neighbors").cast("string")), ("metric", F.col("metric")),
              ("embedding", F.col("embedding"))]
    if with_wtp:
        params.append(("willingness_to_pay", _wtp_text()))
    return variant_name(F.col("router"), params, value_type)


@query("q_macro_mean")
def q_macro_mean(spark, sf_dir):
    m = macro_mean(_vr(spark, sf_dir), ["router", "neighbors", "embedding", "willingness_to_pay"])
    return m.select("router", "neighbors", "embedding", "willingness_to_pay", r6("performance").alias("performance"),
                    r6("total_cost").alias("total_cost"), "n_evals")


@query("q_best_variant")
def q_best_variant(spark, sf_dir):
    b = best_variant(_vr(spark, sf_dir), ["neighbors"], ["embedding"])
    return b.select("eval_name", "embedding", "neighbors", r6("performance").alias("performance"),
                    F.col("total_cost").cast("long").alias("total_cost"), "best_willingness_to_pay")


@query("q_frontier_series")
def q_frontier_series(spark, sf_dir):
    vr = _vr(spark, sf_dir)
    b = best_variant(vr, ["neighbors"], ["embedding"]).select("eval_name", "embedding", "neighbors")
    s = vr.join(b, ["eval_name", "embedding", "neighbors"], "left_semi")
    return s.select("eval_name", "embedding", "neighbors", "willingness_to_pay", "total_cost",
                    r6("performance").alias("performance"))


@query("q_family_series")
def q_family_series(spark, sf_dir):
    """Best variant of each router family (two kNN, two MLP; SVR is not plotted) and the cascade at error rate 0.2."""
    vr = _vr(spark, sf_dir)
    family = F.element_at(F.array(*[F.lit(r) for r in ("knn", "mlp", "knn", "svm", "mlp")]), F.col("v") + 1)
    cascade = vr.select("eval_name", F.lit("cascade").alias("router"), F.lit(-1).alias("neighbors"),
                        (F.col("v") / 10).alias("evaluator_error_rate"), F.col("willingness_to_pay").alias("max_cost_per_response"),
                        "total_cost", "performance")
    s = family_series(vr.withColumn("router", family), cascade, ["router", "neighbors"])
    return s.select("eval_name", "router", F.col("neighbors").cast("int").alias("neighbors"), "x_value", "total_cost",
                    r6("performance").alias("performance"))


def _explode_hull(h, keys):
    x = h.select(*keys, F.posexplode("hull").alias("pos", "pt"))
    return x.select(*keys, F.col("pos").cast("int").alias("pos"), r6("pt.x").alias("x"), r6("pt.y").alias("y"))


@query("q_frontier")
def q_frontier(spark, sf_dir):
    return _explode_hull(ndch(_vr(spark, sf_dir), ["eval_name", "neighbors"]), ["eval_name", "neighbors"])


@query("q_aiq")
def q_aiq(spark, sf_dir):
    a = aiq(_vr(spark, sf_dir), ["eval_name"], ["neighbors"])
    return a.select("eval_name", "neighbors", r6("aiq").alias("aiq"))


@query("q_aiq_ranking")
def q_aiq_ranking(spark, sf_dir):
    r = aiq_ranking(aiq(_vr(spark, sf_dir), ["eval_name"], ["neighbors"]), ["neighbors"])
    return r.select("neighbors", r6("mean_aiq").alias("mean_aiq"), "n_evals")


@query("q_zero_router")
def q_zero_router(spark, sf_dir):
    llm = _scores(spark, sf_dir).where(F.col("model") != "oracle")
    return _explode_hull(ndch(llm, ["eval_name"]), ["eval_name"])


@query("q_leaderboard")
def q_leaderboard(spark, sf_dir):
    s = with_display_name(_scores(spark, sf_dir), display_names(spark))
    return s.select("eval_name", "model", "display_name", r6("performance").alias("performance"), "total_cost")


def _union(spark, sf_dir):
    llm = _scores(spark, sf_dir).withColumnRenamed("model", "router").select(
        "eval_name", "router", "performance", F.col("total_cost").cast("double").alias("total_cost"))
    vr = _vr(spark, sf_dir).select("eval_name", "router", "neighbors", "embedding", "willingness_to_pay",
                                   "performance", F.col("total_cost").cast("double").alias("total_cost"))
    return union_results([vr, llm, vr])


@query("q_results_union")
def q_results_union(spark, sf_dir):
    u = _union(spark, sf_dir)
    return u.select("eval_name", "router", "neighbors", "embedding", "willingness_to_pay",
                    r6("performance").alias("performance"), r6("total_cost").alias("total_cost"))


@query("q_baselines")
def q_baselines(spark, sf_dir):
    m = mark_baselines(_union(spark, sf_dir), MODELS)
    return m.groupBy("router", "is_baseline").agg(F.count(F.lit(1)).alias("n_rows"))


@query("q_results_wide")
def q_results_wide(spark, sf_dir):
    names = MODELS + ["oracle"]
    w = results_wide(_scores(spark, sf_dir), names)
    cols = ["eval_name"]
    for n in names:
        cols += [r6(f"{n}_performance").alias(f"{n}_performance"), r6(f"{n}_total_cost").alias(f"{n}_total_cost")]
    return w.select(*cols)


@query("q_average_accuracy")
def q_average_accuracy(spark, sf_dir):
    s = _scores(spark, sf_dir).where(F.col("model").isin(*MODELS))
    return s.groupBy("eval_name").agg(r6(F.avg("performance")).alias("average_accuracy"))


@query("q_router_names")
def q_router_names(spark, sf_dir):
    return _vr(spark, sf_dir).select(_name(with_wtp=False).alias("router_name")).distinct()


@query("q_variant_name")
def q_variant_name(spark, sf_dir):
    return _vr(spark, sf_dir).select("eval_name", _name(True, "performance").alias("variant"),
                                     r6("performance").alias("performance"))


@query("q_parse_variant")
def q_parse_variant(spark, sf_dir):
    names = _vr(spark, sf_dir).select(_name(True, "performance").alias("variant")).distinct()
    p = names.select("variant", parse_variant(F.col("variant")).alias("p"),
                     parse_params_tolerant(F.col("variant")).alias("t"))
    x = p.select("variant", F.col("p.algorithm").alias("algorithm"), F.col("p.value_type").alias("value_type"),
                 F.explode("p.params").alias("key", "value"), "t")
    return x.select("variant", "algorithm", "value_type", "key", "value",
                    F.element_at(F.col("t"), F.col("key")).alias("tolerant_value"))


@query("q_csv_roundtrip")
def q_csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "eval-results-csv")
    s = eval_scores(eval_long(spark, sf_dir))
    s.write.mode("overwrite").option("header", True).csv(path)
    back = (spark.read.option("header", True)
            .schema("eval_name string, model string, performance double, total_cost_pico long").csv(path))
    return back.select("eval_name", "model", r6("performance").alias("performance"), "total_cost_pico")


@query("q_results_store")
def q_results_store(spark, sf_dir):
    """Union of result tables saved as a partitioned collection (twice, the second time only
    if absent), read back distinct."""
    root = scratch_path(spark, "results-store")
    u = _union(spark, sf_dir)
    save_results(u, root, "eval_results", "fixture")
    save_results(u, root, "eval_results", "fixture", if_absent=True)
    back = load_results(spark, f"{root}/eval_results", "fixture")
    return back.select("eval_name", "router", "neighbors", "embedding", "willingness_to_pay",
                       r6("performance").alias("performance"), r6("total_cost").alias("total_cost"))


@query("q_plot_points")
def q_plot_points(spark, sf_dir):
    """Plotting data of the ``en`` family: kNN variants by wtp and every model incl. the oracle."""
    p = plot_points(_vr(spark, sf_dir), _scores(spark, sf_dir), "en", ["router", "neighbors", "embedding"])
    return p.select("series", "x_value", r6("total_cost").alias("total_cost"), r6("performance").alias("performance"))


@query("q_aiq_embedding")
def q_aiq_embedding(spark, sf_dir):
    """AIQ as the surveyed report computes it: per eval, the kNN rows of each embedding pooled into
    one point set (all k and wtp), embeddings with more than two distinct points compared."""
    a = aiq(_vr(spark, sf_dir).where(F.col("router") == "knn"), ["eval_name"], ["embedding"])
    return a.select("eval_name", "embedding", r6("aiq").alias("aiq"))


@query("q_results_wide_variants")
def q_results_wide_variants(spark, sf_dir):
    names = fixture_variant_names()
    w = results_wide_by_variant(_vr(spark, sf_dir), _name(with_wtp=True), names)
    cols = [f"{n}|{m}" for n in names for m in ("performance", "total_cost")]
    return w.select("eval_name", *[r6(F.col(f"`{c}`")).alias(c) for c in cols])
