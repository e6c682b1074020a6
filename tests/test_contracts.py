"""Keys, money, distances, stores and settings: cases beyond what the registered queries reach."""

import pytest
from pyspark.sql import functions as F

from routelens.functions.logs import metric_value
from routelens.operators.cascade import usd_to_pico
from routelens.operators.knn import knn_topk
from routelens.operators.scores import model_scores
from routelens.plans.evaluate import prepare
from routelens.plans.jobs import convert_long, embedder, fill_store
from routelens.session import path_exists, scratch_path, shared_dir
from routelens.sources.results_io import load_results, save_results

VEC = "g string, sample_id string, embedding array<double>"


def neighbours(spark, train, metric, k=1, query=(0.0, 0.0)):
    q = spark.createDataFrame([("g", "q", list(query))], VEC)
    t = spark.createDataFrame([("g", i, v) for i, v in train], VEC)
    return [(r.neighbor_id, r.sim) for r in sorted(knn_topk(q, t, k, ["g"], metric=metric).collect(), key=lambda r: r.rank)]


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_far_and_near_vectors(spark, metric):
    assert neighbours(spark, [("far", [2e10, 0.0]), ("near", [1.0, 0.0])], metric) == [("near", -1.0)]
    assert neighbours(spark, [("bad", [float("nan"), 0.0]), ("ok", [2e6, 0.0])], metric, 2) == [("ok", -2e6)]


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine"])
def test_tied_vectors_go_by_id(spark, metric):
    train = [("c", [1.0, 0.0]), ("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("d", [5.0, 5.0])]
    assert [n for n, _ in neighbours(spark, train, metric, 3, (1.0, 0.0))] == ["a", "b", "c"]
    want = {"euclidean": 0.0, "manhattan": 0.0, "cosine": 1.0}[metric]
    assert neighbours(spark, train, metric, 1, (1.0, 0.0))[0][1] == want


def test_manhattan_distances_by_value(spark):
    got = neighbours(spark, [("x", [3.0, -4.0]), ("y", [0.5, 0.25])], "manhattan", 2)
    assert got == [("y", -0.75), ("x", -7.0)]


def test_money_totals_pass_bigint(spark):
    df = spark.createDataFrame([("e", "m", 1.0, 9 * 10 ** 18)] * 3, "eval_name string, model string, performance double, cost_pico long")
    assert int(model_scores(df).first().total_cost_pico) == 27 * 10 ** 18
    assert usd_to_pico(1e9) == 10 ** 21


def test_families_may_share_sample_ids(spark):
    rows = [(f, str(i), "e-" + f, m, "m%d" % m, 1.0, 10, [float(i), float(m)], ["a b"])
            for f in ("p", "q") for i in range(60) for m in range(2)]
    df = spark.createDataFrame(rows, "family string, sample_id string, eval_name string, model_idx int, model string, "
                                     "performance double, cost_pico long, embedding array<double>, response array<string>")
    s = prepare(df, 2).samples
    assert s.count() == 120 and s.groupBy("family", "sample_id").count().where("count > 1").count() == 0


def test_convertor_keeps_evals_apart_and_averages_repeats(spark):
    rows = [("1", "A", "m0", 0, ["q"], ["r"], 1.0), ("1", "A", "m1", 1, ["q"], ["r"], 0.0), ("1", "A", "m1", 1, ["q"], ["r"], 1.0),
            ("1", "B", "m0", 0, ["q"], ["r"], 0.0), ("1", "B", "m1", 1, ["q"], ["r"], None)]
    long = spark.createDataFrame(rows, "sample_id string, eval_name string, model string, model_idx int, prompt array<string>, "
                                       "response array<string>, performance double")
    prices = spark.createDataFrame([("m0", 1, 1, None), ("m1", 2, 2, 5)], "model string, prompt_pico long, completion_pico long, request_pico long")
    got = sorted((r.eval_name, r.model, r.performance, r.oracle, r.cost_pico) for r in convert_long(long, prices, F.col("model_idx")).collect())
    assert got == [("A", "m0", 1.0, "m0", 2), ("A", "m1", 0.5, "m0", 9), ("B", "m0", 0.0, "no_model_correct", 2),
                   ("B", "m1", 0.0, "no_model_correct", 9)]


def test_metrics_record_without_a_metric_fails(spark):
    none = [F.lit(None).cast("double")] * 2
    df = spark.range(1).select(metric_value(*none, F.lit(None).cast("string"), F.lit(None).cast("double")).alias("v"))
    with pytest.raises(Exception, match="metrics record"):
        df.collect()
    ok = spark.range(1).select(metric_value(*none, F.lit("__invalid__"), F.lit(None).cast("double")).alias("v"))
    assert ok.first().v is None


def test_store_is_filled_by_the_named_encoder_once(spark):
    path = scratch_path(spark, "store")
    texts = spark.createDataFrame([("a b",), ("c",)], "prompt string")
    encoders = {"mini": (lambda: (lambda xs: [[float(len(x)), 1.0] for x in xs]), 2)}
    assert not path_exists(spark, path)
    for name in ("hash16", "mini", "mini"):
        fill_store(spark, texts, path, name, encoders)
    got = {(r.embedding_model, r.prompt): list(r.embedding) for r in spark.read.parquet(path).collect()}
    assert len(got) == 4 and spark.read.parquet(path).count() == 4
    assert got["mini", "a b"] == [3.0, 1.0] and len(got["hash16", "c"]) == 16
    with pytest.raises(ValueError, match="no encoder"):
        embedder("unknown-model", {})


def test_old_results_name_their_score_accuracy(spark):
    root = scratch_path(spark, "results")
    df = spark.createDataFrame([("m", 0.5)], "model string, accuracy double")
    path = save_results(df, root, "base", "d1")
    assert save_results(df, root, "base", "d1", if_absent=True) == path
    assert spark.read.parquet(path).count() == 1
    assert load_results(spark, path).columns == ["model", "performance"]


def test_cluster_needs_a_shared_folder(spark):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
