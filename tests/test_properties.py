"""Properties from the test strategy, asserted over whole fixture outputs (sf0.001)."""

from pyspark.sql import functions as F

from routelens.operators.cascade import order_chains, simulate
from routelens.operators.frontier import aiq, ndch
from routelens.operators.oracle import oracle_label
from routelens.plans.evaluate import knn_routed, knn_scores, prepare
from routelens.sources.fixtures import eval_long, model_price, router_samples, variant_results
from tests.conftest import SF0001


def test_oracle_dominates_every_model(spark):
    el = eval_long(spark, SF0001)
    lab = oracle_label(el).select("sample_id", "oracle", "oracle_performance", "oracle_cost_pico")
    j = el.join(lab, "sample_id").where(F.col("performance").isNotNull())
    assert j.where(F.col("performance") > F.col("oracle_performance")).count() == 0
    # among models with the oracle's performance, none is cheaper (when some model earned credit)
    eq = j.where((F.col("oracle") != "no_model_correct") & (F.col("performance") == F.col("oracle_performance")))
    assert eq.where(F.col("cost_pico") < F.col("oracle_cost_pico")).count() == 0


def test_hull_is_above_points_up_to_its_peak(spark):
    vr = variant_results(spark, SF0001)
    hulls = {(r.eval_name, r.neighbors): [(p.x, p.y) for p in r.hull] for r in ndch(vr, ["eval_name", "neighbors"]).collect()}
    for r in vr.collect():
        h = hulls[(r.eval_name, r.neighbors)]
        x, y = float(r.total_cost), r.performance
        if x > h[-1][0]:
            assert y <= h[-1][1] + 1e-12          # beyond the peak the frontier is flat
            continue
        for (x1, y1), (x2, y2) in zip(h, h[1:]):
            if x1 <= x <= x2:
                assert y <= y1 + (y2 - y1) * (x - x1) / (x2 - x1) + 1e-9
                break


def test_aiq_within_performance_range(spark):
    vr = variant_results(spark, SF0001)
    top = {r.eval_name: r.m for r in vr.groupBy("eval_name").agg(F.max("performance").alias("m")).collect()}
    for r in aiq(vr, ["eval_name"], ["neighbors"]).collect():
        assert 0.0 <= r.aiq <= top[r.eval_name] + 1e-12


def test_wtp_extremes(spark):
    rd = prepare(router_samples(spark, SF0001), 5)
    routed = knn_routed(rd, model_price(spark), ks=[5], wtp_values=[1e-10, 1e9])
    sc = knn_scores(rd, [5]).select("query_id", "scores")
    j = routed.join(sc, "query_id").collect()
    assert len(j) > 0
    for r in j:
        if r.wtp == 1e-10:
            assert r.chosen == "m0"                             # the cheapest model
        else:
            best = max(range(5), key=lambda i: (r.scores[i], -i))
            assert r.chosen == f"m{best}"                      # the best predicted model


def test_cascade_extremes(spark):
    el = eval_long(spark, SF0001).withColumn("performance", F.coalesce("performance", F.lit(0.0)))
    answers = el.groupBy("eval_name", "sample_id").agg(F.array_sort(F.collect_list(
        F.struct("model_idx", "model", "performance", "cost_pico"))).alias("answers"))
    price = el.select("eval_name").distinct().withColumn("price", F.array(*[F.lit(float(i)) for i in range(5)]))
    thr = el.select("eval_name").distinct().withColumn("threshold", F.lit(0.5))
    ch = order_chains(answers, price, thr)
    out = simulate(ch, budgets=[1e9], error_rates=[0.0]).join(answers, ["eval_name", "sample_id"]).collect()
    for r in out:
        perfs = [a.performance for a in sorted(r.answers, key=lambda a: a.model_idx)]
        first_ok = next((i for i, p in enumerate(perfs) if p >= 0.5), len(perfs) - 1)
        assert r.last_performance == perfs[first_ok]            # first acceptable model, else the last
        assert r.spent_pico == sum(a.cost_pico for a in sorted(r.answers, key=lambda a: a.model_idx)[:first_ok + 1])


def test_split_is_complete_disjoint_and_exact(spark):
    import math
    from routelens.operators.split import split_by_source, split_samples
    s = eval_long(spark, SF0001).select("family", "source", "sample_id").distinct()
    for sp in (split_samples(s), split_by_source(s)):
        assert sp.count() == s.count() == sp.select("sample_id").distinct().count()   # each prompt once
    sizes = {r.family: r.n for r in s.groupBy("family").agg(F.count("*").alias("n")).collect()}
    train = {r.family: r.n for r in split_samples(s).where("split = 'train'").groupBy("family")
             .agg(F.count("*").alias("n")).collect()}
    assert all(train.get(f, 0) == math.floor(n * 0.7) for f, n in sizes.items())
