"""What moves between tasks: counts instead of texts, single precision as it is, one row of buckets per text."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from routelens.functions.text import n_tokens_all
from routelens.operators import knn as K
from routelens.operators.cost import price_answers
from routelens.operators.embed import hash_embed, hash_embed_weights
from tests.conftest import SF0001
from tests.test_knn_cells import brute


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["q_token_cost", "q_convert_long"])
def test_texts_are_counted_before_they_are_grouped(spark, name):
    text = plan(E.queries()[name](spark, SF0001))
    assert "first(prompt" not in text and "first(array(text" not in text


def test_converted_responses_stay_where_they_are_read(spark):
    text = plan(E.queries()["q_convert_job"](spark, SF0001))
    collected = [line for line in text.splitlines() if "collect_list" in line]
    assert collected and all("response, response" not in line for line in collected)


def test_csv_rows_do_not_meet_by_model(spark):
    text = plan(E.queries()["q_convert_csv"](spark, SF0001))
    assert "hashpartitioning(model" not in text and text.count("FileScan csv") == 1


def test_counted_answers_cost_the_same(spark):
    d = spark.createDataFrame([("a", ["one two", "three"], [("m0", 0, ["x y"]), ("m1", 1, [""])]), ("b", [""], [("m1", 1, ["z"])])],
                              "sample_id string, prompt array<string>, answers array<struct<model:string,model_idx:int,response:array<string>>>")
    prices = spark.createDataFrame([("m0", 3, 5, 7), ("m1", 11, 13, None)],
                                   "model string, prompt_pico long, completion_pico long, request_pico long")
    counted = d.select("sample_id", n_tokens_all("prompt").alias("prompt"), F.transform("answers", lambda a: F.struct(
        a["model"].alias("model"), a["model_idx"].alias("model_idx"), n_tokens_all(a["response"]).alias("response"))).alias("answers"))
    got = [sorted((r.sample_id, r.model, r.cost_pico) for r in price_answers(x, prices).collect()) for x in (d, counted)]
    assert got[0] == got[1] == [("a", "m0", 26), ("a", "m1", 33), ("b", "m1", 13)]


def test_embedder_makes_one_row_per_text(spark):
    d = spark.createDataFrame([(1, "The cat\tthe\x0bCAT Été"), (2, None), (3, ""), (4, "a b"), (4, "b c"), (None, "z")], "k long, t string")
    w = hash_embed_weights(d, "t", "k", 8)
    assert "Generate" not in plan(w)
    import hashlib

    def buckets(tokens):
        out = [0] * 8
        for t in tokens:
            h = hashlib.md5(t.encode()).hexdigest()
            out[int(h[:4], 16) % 8] += 1 if h[4] < "8" else -1
        return out
    want = {1: buckets(["the", "cat", "the", "cat", "été"]), 2: [0] * 8, 3: [0] * 8, 4: buckets(["a", "b", "b", "c"]), None: buckets(["z"])}
    assert {r.k: r.weights for r in w.collect()} == want
    for r in hash_embed(d, "t", "k", 8).collect():
        v = np.array(want[r.k], float)
        assert np.allclose(r.embedding, v / (np.linalg.norm(v) or 1.0), atol=1e-6)


def test_vectors_move_in_their_own_precision(spark, monkeypatch):
    seen = {}

    def kept(df, name, materialize=K.materialize):
        seen[name] = df.schema
        return materialize(df, name)
    monkeypatch.setattr(K, "materialize", kept)
    t = spark.createDataFrame([(1, "g", [1.0, 0.0]), (2, "g", [0.0, 1.0])], "sample_id long, g string, embedding array<float>")
    assert [r.neighbor_id for r in K.knn_topk(t, t, 1, ["g"]).orderBy("query_id").collect()] == [1, 2]
    assert seen["knn-shards"]["vec"].dataType.simpleString() == "array<float>"


@pytest.mark.parametrize("metric", K.METRICS)
@pytest.mark.parametrize("shift, scale", [(0.0, 1.0), (1000.0, 1.0), (0.0, 1e20), (0.0, 1e-20)])
def test_single_precision_only_proposes(metric, shift, scale):
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(700, 24)) + shift) * scale
    x[50:90] = x[3]                                        # copies: ties by id
    cells = K.Cells(metric, np.arange(len(x)), x, np.arange(len(x)) % 3)
    i, row, _ = cells.nearest(x[:40], 9, np.full(40, -np.inf))
    assert [row[i == a].tolist() for a in range(40)] == brute(x[:40], x, 9, metric)


def test_a_block_of_queries_meets_a_cell_once(monkeypatch):
    """One product of matrices for all queries that ask a cell, in place of one per round of visits."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 32))
    cells, calls = K.Cells("cosine", np.arange(2000), x, np.arange(2000) % 10), []
    likely = K.Cells.likely
    monkeypatch.setattr(K.Cells, "likely", lambda self, asked, part, a, *rest: calls.append(a) or likely(self, asked, part, a, *rest))
    cells.nearest(x[:500], 5, np.full(500, -np.inf))
    assert max(calls.count(a) for a in set(calls)) <= 2
