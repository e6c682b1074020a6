"""The three jobs end to end on the surveyed tool's input shape (long CSV with printed lists)."""

import json
import os

from pyspark.sql import functions as F

from routelens.plans.jobs import (AnalyseOptions, ConvertOptions, EvaluateOptions, analyse_job, convert_job,
                                  evaluate_job, options_from)
from routelens.plans.evaluate import Grid
from routelens.session import scratch_path
from routelens.sources.fixtures import eval_long, list_literal
from tests.conftest import SF0001


def test_convert_evaluate_analyse(spark):
    base = scratch_path(spark, "jobs")
    el = eval_long(spark, SF0001)
    el.select("sample_id", "eval_name", F.col("model").alias("model_name"), list_literal(F.col("prompt")).alias("prompt"),
              list_literal(F.col("response")).alias("model_response"), "performance"
              ).write.option("header", True).option("escape", '"').csv(f"{base}/in")
    os.makedirs(base, exist_ok=True)
    with open(f"{base}/prices.csv", "w") as f:   # the fixture models: (m+1) and 2(m+1) USD per 10M tokens
        f.write("model,prompt_usd_per_10m_tokens,completion_usd_per_10m_tokens,request_usd\n")
        for m in range(5):
            f.write(f"m{m},{m + 1},{2 * (m + 1)},{'0.005' if m == 4 else ''}\n")
    conv = convert_job(spark, ConvertOptions(f"{base}/in", f"{base}/conv", "csv", f"{base}/store",
                                             prices_path=f"{base}/prices.csv"))
    c = spark.read.parquet(conv)
    assert c.count() == el.count()
    diff = c.join(el.select("sample_id", "model", F.col("cost_pico").alias("c0")), ["sample_id", "model"])
    assert diff.where(F.col("cost_pico") != F.col("c0")).count() == 0          # prices from the price list
    assert c.where(F.col("performance").isNull()).count() == 0                # filled after the oracle
    store = spark.read.parquet(f"{base}/store")
    assert store.select("hash").distinct().count() == c.select("prompt").distinct().count()
    langs = sorted(r.eval_name.split("-")[0] for r in c.select("eval_name").distinct().collect())
    res = evaluate_job(spark, EvaluateOptions(conv, f"{base}/store", f"{base}/results",
                                              wanted_evals=sorted(set(langs)), grid=Grid(mlp_epochs=3),
                                              prices_path=f"{base}/prices.csv", csv_path=f"{base}/results_csv"))
    r = spark.read.parquet(res)
    routers = {x.router for x in r.select("router").distinct().collect()}
    assert {"knn", "svm", "mlp", "cascading router", "oracle", "m0"} <= routers
    csv = spark.read.option("header", True).csv(f"{base}/results_csv")
    assert csv.count() == r.count() and {"model_name", "total_cost", "willingness_to_pay"} <= set(csv.columns)
    ood = evaluate_job(spark, EvaluateOptions(conv, f"{base}/store", f"{base}/results_ood",
                                              wanted_evals=sorted(set(langs)), out_of_distribution=True,
                                              prices_path=f"{base}/prices.csv", routers=("knn", "svm")))
    o = spark.read.parquet(ood)
    assert {x.eval_name for x in o.select("eval_name").distinct().collect()} == set(langs)
    assert o.where(F.col("router") == "knn").count() > 0
    assert {x.router for x in o.select("router").distinct().collect()} & {"mlp", "cascading router"} == set()
    out = analyse_job(spark, AnalyseOptions(res, f"{base}/analysis"))
    for name, path in out.items():
        assert spark.read.parquet(path).count() > 0, name

    # a grid from a file: two vector spaces of different width under two metrics
    with open(f"{base}/grid.json", "w") as f:
        json.dump({"data_path": conv, "store_path": f"{base}/store", "output_path": f"{base}/results_grid", "wanted_evals": langs,
                   "embedding_models": ["hash32", "hash8"], "prices_path": f"{base}/prices.csv", "routers": ["knn", "cascading router"],
                   "split_by": "sample", "grid": {"neighbors": [3, 7], "metrics": ["cosine", "euclidean"], "wtp_values": [0.1, 10.0],
                                                  "cascade_budgets": [0.01], "cascade_error_rates": [0.2]}}, f)
    g = spark.read.parquet(evaluate_job(spark, options_from(spark, f"{base}/grid.json", EvaluateOptions)))
    knn = g.where(F.col("router") == "knn").groupBy("embedding", "metric", "neighbors", "wtp").count().collect()
    n_evals = g.select("eval_name").distinct().count()
    assert len(knn) == 2 * 2 * 2 * 2 and all(x["count"] == n_evals for x in knn)
    assert g.where(F.col("router") == "cascading router").count() == n_evals
    alone = spark.read.parquet(evaluate_job(spark, EvaluateOptions(
        conv, f"{base}/store", f"{base}/results_alone", wanted_evals=langs, embedding_models=["hash8"], prices_path=f"{base}/prices.csv",
        routers=("knn",), grid=Grid(neighbors=[7], metrics=["euclidean"], wtp_values=[10.0]))))
    same = ["eval_name", "embedding", "metric", "neighbors", "wtp", "performance", "total_cost_pico"]
    part = g.where((F.col("embedding") == "hash8") & (F.col("metric") == "euclidean") & (F.col("neighbors") == 7) & (F.col("wtp") == 10.0))
    assert sorted(map(tuple, part.select(*same).collect())) == sorted(map(tuple, alone.where(F.col("router") == "knn").select(*same).collect()))
