"""Router inputs: texts are counted and embedded where they are read, vectors meet prompts, not texts."""

import pytest
from pyspark.sql import functions as F

from routelens.plans.evaluate import prepare
from routelens.sources.fixtures import eval_long_from
from routelens.sources.tables import dealt

TEXTS = ["", " \t", "a", "a b", "a b c d e", "a\x0bb\nc  d e f ", "é ü ñ $1 \\S {2} g h i j k l", "x" * 3000 + " y", None]


def documents(spark, ids=None):
    ids = range(len(TEXTS)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en" if i is None or i % 2 else "fr", "s") for i, t in zip(ids, TEXTS, strict=True)],
                                 "doc_id long, text string, lang string, source string")


def test_responses_hold_their_words(spark):
    got = {(r.doc_id, r.model_idx): (r.response[0], r.cost_pico) for r in eval_long_from(documents(spark)).collect()}
    for i, t in enumerate(TEXTS):
        for m in range(5):
            if t is None:
                assert got[i, m] == (None, None)
                continue
            words = t.split()
            said = [w for n, w in enumerate(words) if n % 5 <= m]
            assert got[i, m] == (" ".join(said), (m + 1) * (len(words) * 100000 + len(said) * 200000) + (5000000000 if m == 4 else 0))


@pytest.mark.parametrize("split_by", ["sample", "source"])
def test_vectors_meet_prompts_as_they_met_answers(spark, split_by):
    d = documents(spark, [0, 1, 1, None, 4, 5, 6, 7, 8])
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (4, [0.0, 1.0]), (4, [0.0, 1.0]), (5, None), (6, [1.0, 1.0]),
                               (None, [2.0, 2.0]), (99, [3.0, 3.0])], "doc_id long, embedding array<float>")
    joined = prepare(eval_long_from(d.join(v, "doc_id"), keep=("embedding",)), 5, split_by=split_by)
    met = prepare(eval_long_from(d), 5, split_by=split_by, vectors=v)
    for view in ("samples", "long"):
        a, b = getattr(joined, view), getattr(met, view)
        assert sorted(a.columns) == sorted(b.columns)
        cols = sorted(a.columns)
        assert sorted(map(str, a.select(cols).collect())) == sorted(map(str, b.select(cols).collect()))


def test_as_many_files_as_cores_are_not_dealt_again(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    for n in (cores, 1):
        spark.range(100).repartition(n).write.parquet(f"{tmp_path}/{n}")
    many, one = (dealt(spark.read.parquet(f"{tmp_path}/{n}")) for n in (cores, 1))
    assert "RoundRobin" not in many._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobin" in one._jdf.queryExecution().executedPlan().toString()
    assert many.agg(F.sum("id")).first() == one.agg(F.sum("id")).first()


def test_baselines_count_no_responses(spark):
    rd = prepare(eval_long_from(documents(spark)), 5, tokens=False,
                 vectors=spark.range(3).select(F.col("id").alias("doc_id"), F.array(F.lit(1.0)).alias("embedding")))
    assert "response_tokens" not in rd.long.columns and rd.samples.count() == 3
