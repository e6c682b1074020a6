"""Plug-ins: tokenizers per model, convertors by format name, routers by name with kept weights."""

import json
import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from routelens.operators.cost import price_answers
from routelens.plans import evaluate as V
from routelens.plans.convertors import LONG, convertor, read_answers
from routelens.plans.jobs import AnalyseOptions, ConvertOptions, EvaluateOptions, analyse_job, convert_job, evaluate_job
from routelens.session import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])   # tasks can't import the tests

PRICES = [("a", 3, 5, None), ("b", 7, 11, 13), ("c", 2, 2, 1)]
ODD = ["", "one two", "don't stop,  now", "tab\tand\nline", "naïve café 東京", "x" * 5000, "a-b " * 3000]


def prices(spark, own=None):
    p = spark.createDataFrame(PRICES, "model string, prompt_pico long, completion_pico long, request_pico long")
    return p if own is None else p.withColumn("tokenizer", F.create_map(*[F.lit(x) for kv in own.items() for x in kv])[F.col("model")])


def letters():
    return lambda text: sum(c.isalpha() for c in text)


def samples(spark):
    rows = [(str(i), [t, "again " + t], [(m, [ODD[(i + j) % len(ODD)], t]) for j, (m, *_) in enumerate(PRICES)]) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "sample_id string, prompt array<string>, answers array<struct<model string, response array<string>>>"), rows


def check_costs(spark, counters, tokenizers):
    df, rows = samples(spark)
    got = {(r.sample_id, r.model): (r.cost_pico, r.response_tokens)
           for r in price_answers(df, prices(spark, {m: n for m, (n, _) in counters.items()}), tokenizers=tokenizers).collect()}
    want = {}
    for sid, prompt, answers in rows:
        for m, response in answers:
            _, pp, cp, fee = next(p for p in PRICES if p[0] == m)
            count = counters.get(m, (None, lambda t: len(t.split())))[1]
            said = sum(map(count, response))
            want[sid, m] = (sum(map(count, prompt)) * pp + said * cp + (fee or 0), said)
    assert got == want


def test_models_count_tokens_their_own_way(spark):
    check_costs(spark, {"b": ("letters", letters())}, {"letters": letters})
    df, _ = samples(spark)
    plain = price_answers(df, prices(spark))
    assert "response_tokens" not in plain.columns
    same = price_answers(df, prices(spark, {"a": "whitespace"}), tokenizers={"letters": letters})
    assert sorted(plain.select("sample_id", "model", "cost_pico").collect()) == sorted(same.select("sample_id", "model", "cost_pico").collect())
    with pytest.raises(Exception, match="no tokenizer missing"):
        price_answers(df, prices(spark, {"a": "missing"}), tokenizers={"letters": letters}).collect()
    nulls = spark.createDataFrame([("n", None, [("a", None), ("b", [None, "x"])])], df.schema)
    assert {r.cost_pico for r in price_answers(nulls, prices(spark, {"b": "letters"}), tokenizers={"letters": letters}).collect()} == {None}
    assert price_answers(df.limit(0), prices(spark, {"b": "letters"}), tokenizers={"letters": letters}).count() == 0


def test_a_real_tokenizer(spark):
    public = pytest.importorskip("public_tokenizers")
    path = str(public.path("byte_bpe_50k.json"))

    def bpe():
        from tokenizers import Tokenizer
        t = Tokenizer.from_file(path)
        return lambda text: len(t.encode(text, add_special_tokens=False).ids)

    check_costs(spark, {"a": ("bpe", bpe()), "c": ("letters", letters())}, {"bpe": bpe, "letters": letters})


def long_rows(n=60):
    """Two evals; which model is right follows from the prompt's last word."""
    out = []
    for i in range(n):
        word = ("red", "blue", "green")[i % 3]
        for j, (m, *_) in enumerate(PRICES):
            out.append((f"s{i}", "ev1" if i % 2 else "ev2", m, [f"question {i} {word}"], [f"answer {word}'s {m}"], float(j == i % 3)))
    return out


def test_convertor_by_name_and_by_data_source(spark):
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
    base = scratch_path(spark, "plugin")
    os.makedirs(f"{base}/kv")
    rows = long_rows(12)
    for part in range(3):
        with open(f"{base}/kv/{part}.txt", "w") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows[part::3])

    @convertor("triples")
    def read_triples(spark, path):
        j = F.from_json("value", "array<string>")
        as_list = lambda c: F.from_json(c, "array<string>")
        return spark.read.text(path).select(j.alias("j")).select(
            *[F.col("j")[i].alias(c) for i, c in enumerate(LONG[:3])], as_list(F.col("j")[3]).alias("prompt"),
            as_list(F.col("j")[4]).alias("response"), F.col("j")[5].cast("double").alias("performance"))

    class Answers(DataSource):
        @classmethod
        def name(cls):
            return "answers_kv"

        def schema(self):
            return ("sample_id string, eval_name string, model_name string, prompt array<string>, "
                    "model_response array<string>, performance double")

        def reader(self, schema):
            return AnswersReader(self.options["path"])

    class AnswersReader(DataSourceReader):
        def __init__(self, path):
            self.path = path

        def partitions(self):      # a task per file
            return [InputPartition(name) for name in sorted(os.listdir(self.path))]

        def read(self, partition):
            with open(f"{self.path}/{partition.value}") as f:
                for line in f:
                    yield tuple(json.loads(line))

    spark.dataSource.register(Answers)
    want = sorted(rows)
    for fmt in ("triples", "answers_kv"):
        assert sorted(tuple(r) for r in read_answers(spark, f"{base}/kv", fmt).collect()) == want
    price_file(base)
    made = [spark.read.parquet(convert_job(spark, ConvertOptions(f"{base}/kv", f"{base}/{fmt}", fmt, prices_path=f"{base}/prices.csv")))
            for fmt in ("triples", "answers_kv")]
    assert sorted(map(str, made[0].collect())) == sorted(map(str, made[1].collect())) and made[0].count() == len(rows)

    @convertor("short")
    def read_short(spark, path):
        return spark.read.text(path).select(F.col("value").alias("sample_id"))

    with pytest.raises(ValueError, match="gives no column eval_name"):
        read_answers(spark, f"{base}/kv", "short")


def price_file(base):
    with open(f"{base}/prices.csv", "w") as f:
        f.write("model,prompt_usd_per_10m_tokens,completion_usd_per_10m_tokens,request_usd\na,1,2,\nb,2,3,\nc,3,4,0.001\n")


def mean_router():
    """The train prompts' mean grade of every model, whatever the prompt; ``shift`` only names a variant."""
    def fit(train, n_models, grid):
        return train.groupBy("family").agg(F.array(*[F.avg(F.col("perf")[i]) for i in range(n_models)]).alias("mean"))

    def score(test, weights, n_models, grid):
        return test.join(weights, "family").select("family", F.col("sample_id").alias("query_id"), F.col("mean").alias("scores"),
                                                   F.explode(F.array(F.lit(0), F.lit(1))).alias("shift"))
    return V.Router("mean", fit, score, ("shift",))


def test_user_router_in_the_jobs(spark):
    base = scratch_path(spark, "router")
    os.makedirs(base)
    spark.createDataFrame(long_rows(), "sample_id string, eval_name string, model_name string, prompt array<string>, "
                          "model_response array<string>, performance double").write.parquet(f"{base}/in")
    price_file(base)
    conv = convert_job(spark, ConvertOptions(f"{base}/in", f"{base}/conv", store_path=f"{base}/store", embedding_models=["hash8"],
                                             prices_path=f"{base}/prices.csv", tokenizers={"letters": letters},
                                             model_tokenizers={"b": "letters"}))
    c = spark.read.parquet(conv)
    assert {r.response_tokens for r in c.where("model = 'a'").collect()} == {3}
    assert {r.response_tokens for r in c.where("model = 'b' AND prompt[0] LIKE '%red'").collect()} == {len("answerredsb")}
    V.register_router(mean_router())
    grid = V.Grid(neighbors=[3], metrics=["cosine"], wtp_values=[0.1, 10.0], mlp_epochs=2, mlp_hidden_layers=[(4,)],
                  mlp_activations=["relu"], mlp_learning_rates=[0.01])
    opts = EvaluateOptions(conv, f"{base}/store", f"{base}/res", embedding_models=["hash8"], prices_path=f"{base}/prices.csv",
                           routers=("knn", "svm", "mlp", "mean"), grid=grid, weights_path=f"{base}/weights")
    res = spark.read.parquet(evaluate_job(spark, opts))
    counts = {r.router: r["count"] for r in res.where("wtp IS NOT NULL").groupBy("router").count().collect()}
    assert counts == {"knn": 4, "svm": 4, "mlp": 4, "mean": 8}          # two evals x two wtp (x two shifts)

    # kept weights score prompts that were never fitted, as the same weights in memory do
    test = spark.read.parquet(conv).where("model_idx = 0").select(
        F.col("eval_name").alias("family"), "sample_id", F.array(*[F.lit(float(i)).cast("float") for i in range(8)]).alias("embedding"))
    for router in ("knn", "svm", "mlp", "mean"):
        kept = V.saved_scores(test, f"{base}/weights", router, "hash8", 3, grid).collect()
        w = spark.read.parquet(V.weights_of(f"{base}/weights", router, "hash8"))
        again = V.ROUTERS[router].score(test, w, 3, grid).collect()
        assert len(kept) == 60 * (2 if router == "mean" else 1) and sorted(map(str, kept)) == sorted(map(str, again))
    mean = {(r.family, tuple(r["mean"])) for r in spark.read.parquet(V.weights_of(f"{base}/weights", "mean", "hash8")).collect()}
    assert len(mean) == 2 and all(abs(sum(m) - 1) < 1e-9 for _, m in mean)

    out = analyse_job(spark, AnalyseOptions(f"{base}/res", f"{base}/analysis"))
    names = spark.read.parquet(out["router_names"]).where("router = 'mean'").select("shift").collect()
    assert sorted(r["shift"] for r in names) == ["0", "1"]
    with pytest.raises(ValueError, match="unknown router families"):
        evaluate_job(spark, EvaluateOptions(conv, f"{base}/store", f"{base}/res2", embedding_models=["hash8"],
                                            prices_path=f"{base}/prices.csv", routers=("nobody",)))


def test_out_of_distribution_takes_the_families_that_the_rows_hold(spark):
    rows = [(f"fam{i % 5}", f"s{i}", f"src{i % 3}") for i in range(100)] + [(None, "lost", "src0")]
    df = spark.createDataFrame(rows, "family string, sample_id string, source string")
    from routelens.operators.split import families
    assert families(df) == [f"fam{i}" for i in range(5)]
    assert families(df.limit(0)) == []
