"""Hand-made cases for the semantic decisions (ties, NULL/NaN, zero cost, degenerate hulls)."""

import math

import pytest
from pyspark.sql import functions as F

from routelens.operators.cascade import order_chains, simulate
from routelens.operators.frontier import aiq, ndch
from routelens.operators.knn import knn_topk
from routelens.operators.oracle import oracle_label
from routelens.operators.routing import route
from routelens.operators.split import leak_check, split_members
from routelens.functions.variants import parse_params_tolerant, parse_variant

LONG = "sample_id string, eval_name string, model string, model_idx int, performance double, cost_pico long"


def _oracle(spark, rows):
    df = spark.createDataFrame(rows, LONG)
    return {r.sample_id: (r.oracle, r.oracle_performance, r.oracle_cost_pico) for r in oracle_label(df).collect()}


def test_oracle_ties_zero_null(spark):
    rows = [
        ("tie", "e", "a", 0, 1.0, 5), ("tie", "e", "b", 1, 1.0, 5), ("tie", "e", "c", 2, 1.0, 7),
        ("zero", "e", "a", 0, 0.0, 5), ("zero", "e", "b", 1, 0.0, 1),
        ("null", "e", "a", 0, None, 5), ("null", "e", "b", 1, None, 1),
        ("cheap", "e", "a", 0, 0.5, 9), ("cheap", "e", "b", 1, 0.5, 3), ("cheap", "e", "c", 2, None, 0),
        ("nocost", "e", "a", 0, 1.0, None), ("nocost", "e", "b", 1, 1.0, 8),
    ]
    o = _oracle(spark, rows)
    assert o["tie"] == ("a", 1.0, 5)            # equal performance and cost: lowest index
    assert o["zero"] == ("no_model_correct", 0.0, 0)
    assert o["null"] == ("no_model_correct", 0.0, 0)
    assert o["cheap"] == ("b", 0.5, 3)          # NULL performance never competes
    assert o["nocost"] == ("b", 1.0, 8)         # an unknown cost loses the tie


def test_route_ties_nan_and_zero_wtp(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5, float("nan")], [1e-7, 1e-7, 0.0])],
                               "query_id int, scores array<double>, price array<double>")
    out = {r.wtp: r.chosen_idx for r in route(df, [0.0, 1e-10, 1e9]).collect()}
    assert out[0.0] == 0        # plain arg-max, first wins; NaN never chosen
    assert out[1e-10] == 0
    assert out[1e9] == 0


def test_route_prefers_cheaper_at_low_wtp(spark):
    df = spark.createDataFrame([(1, [0.4, 0.9], [1e-8, 1e-6])], "query_id int, scores array<double>, price array<double>")
    out = {r.wtp: r.chosen_idx for r in route(df, [1e-10, 1e9]).collect()}
    assert out[1e-10] == 0 and out[1e9] == 1


def test_cascade_free_first_model_and_exact_budget(spark):
    answers = spark.createDataFrame(
        [("e", "s", [(0, "a", 0.0, 0), (1, "b", 0.0, 100), (2, "c", 1.0, 50)])],
        "eval_name string, sample_id string, answers array<struct<model_idx:int,model:string,performance:double,cost_pico:long>>")
    price = spark.createDataFrame([("e", [1.0, 2.0, 3.0])], "eval_name string, price array<double>")
    thr = spark.createDataFrame([("e", 1.0)], "eval_name string, threshold double")
    ch = order_chains(answers, price, thr)
    # budget 1e-10 USD = 100 pico: the free answer does not arm the budget test, model b (cost 100) is bought,
    # then c (50 >= 100 - 100 remaining) stops the cascade
    r = simulate(ch, budgets=[1e-10], error_rates=[0.0]).collect()[0]
    assert r.spent_pico == 100 and r.last_performance == 0.0
    r = simulate(ch, budgets=[1.0], error_rates=[0.0]).collect()[0]
    assert r.spent_pico == 150 and r.last_performance == 1.0


def _hull(spark, pts):
    df = spark.createDataFrame([("g", float(x), float(y)) for x, y in pts], "g string, total_cost double, performance double")
    return [(p.x, p.y) for p in ndch(df, ["g"]).collect()[0].hull]


def test_hull_small_and_degenerate(spark):
    assert _hull(spark, [(1, 2)]) == [(1.0, 2.0)]
    assert _hull(spark, [(1, 2), (3, 1)]) == [(1.0, 2.0)]          # falling second point is cut
    assert _hull(spark, [(0, 0), (1, 1), (2, 2)]) == [(0.0, 0.0), (2.0, 2.0)]   # collinear middle dropped
    assert _hull(spark, [(1, 0.2), (1, 0.5), (2, 0.6)]) == [(1.0, 0.5), (2.0, 0.6)]  # equal x: max y
    assert _hull(spark, [(0, 0), (1, 0.9), (2, 0.95), (3, 0.5)]) == [(0.0, 0.0), (1.0, 0.9), (2.0, 0.95)]


def test_hull_matches_brute_force(spark):
    import random
    rnd = random.Random(7)
    for _ in range(5):
        pts = [(rnd.randint(0, 50), round(rnd.random(), 3)) for _ in range(12)]
        got = _hull(spark, pts)
        best = {}
        for x, y in pts:
            best[x] = max(best.get(x, -1), y)
        xs = sorted(best)
        verts = []
        for i, x in enumerate(xs):
            y = best[x]
            below = any((x - a) * (best[b] - best[a]) - (y - best[a]) * (b - a) >= 0
                        for a in xs if a < x for b in xs if b > x)
            if not below:
                verts.append((float(x), y))
        nd = [v for i, v in enumerate(verts) if i == 0 or v[1] >= verts[i - 1][1]]
        assert got == nd


def test_aiq_all_x_zero_is_null(spark):
    df = spark.createDataFrame([("e", 1, 0.0, 0.1), ("e", 1, 0.0, 0.2), ("e", 1, 0.0, 0.3)],
                               "eval_name string, v int, total_cost double, performance double")
    r = aiq(df, ["eval_name"], ["v"]).collect()
    assert len(r) == 1 and r[0].aiq is None


def test_aiq_flat_extension(spark):
    df = spark.createDataFrame([("e", 1, 0.0, 0.0), ("e", 1, 1.0, 1.0), ("e", 1, 2.0, 1.0),
                                ("e", 2, 0.0, 0.5), ("e", 2, 4.0, 0.5), ("e", 2, 1.0, 0.4)],
                               "eval_name string, v int, total_cost double, performance double")
    r = {x.v: x.aiq for x in aiq(df, ["eval_name"], ["v"]).collect()}
    assert math.isclose(r[1], (0.5 + 1.0 + 2.0) / 4.0)
    assert math.isclose(r[2], 0.5)


def test_variant_parsers(spark):
    df = spark.createDataFrame([("knn|neighbors:5|metric:a:b|total_cost",), ("m0|performance",), ("plain",)], "v string")
    rows = df.select("v", parse_variant(F.col("v")).alias("p"), parse_params_tolerant(F.col("v")).alias("t")).collect()
    r = {x.v: x for x in rows}
    assert r["knn|neighbors:5|metric:a:b|total_cost"].p.params == {"neighbors": "5", "metric": "a:b"}
    assert r["knn|neighbors:5|metric:a:b|total_cost"].t == {"neighbors": "5", "metric": "a"}
    assert r["m0|performance"].p.algorithm == "m0" and r["m0|performance"].p.params == {}
    assert r["plain"].t == {}
    with pytest.raises(Exception):
        spark.createDataFrame([("x|k:1|k:2|v",)], "v string").select(parse_variant(F.col("v"))).collect()


def test_split_exact_sizes_and_disjoint(spark):
    rows = [("big", f"s{i}") for i in range(2000)] + [("tiny", "t0"), ("tiny", "t1"), ("tiny", "t2")]
    df = spark.createDataFrame(rows, "family string, sample_id string")
    s = split_members(df, "family", "sample_id", 0.7, "42")
    counts = {(r.family, r.split): r.n for r in s.groupBy("family", "split").agg(F.count("*").alias("n")).collect()}
    assert counts[("big", "train")] == 1400 and counts[("big", "test")] == 600
    assert counts[("tiny", "train")] == 2 and counts[("tiny", "test")] == 1
    assert all(r.n_overlap == 0 for r in leak_check(s).collect())


def test_knn_multi_block_equals_single_block(spark):
    import random
    rnd = random.Random(3)
    vec = lambda: [rnd.uniform(-1, 1) for _ in range(8)]
    q = spark.createDataFrame([("g", f"q{i}", vec()) for i in range(60)], "g string, sample_id string, embedding array<double>")
    t = spark.createDataFrame([("g", f"t{i:03d}", vec()) for i in range(300)], "g string, sample_id string, embedding array<double>")
    one = knn_topk(q, t, 7, ["g"], shard_rows=100000).select("query_id", "neighbor_id", "rank").collect()
    many = knn_topk(q, t, 7, ["g"], shard_rows=25, cell_rows=5).select("query_id", "neighbor_id", "rank").collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))
    for metric in ("euclidean", "manhattan"):
        assert knn_topk(q, t, 3, ["g"], metric=metric, shard_rows=50, cell_rows=10).count() == 180


def test_linear_abs_recovers_planted_weights(spark):
    import numpy as np
    from routelens.operators.learned import fit_linear_abs
    rng = np.random.default_rng(0)
    X = rng.normal(size=(600, 4))
    w = np.array([[0.5, -0.2, 0.1, 0.3], [-0.4, 0.25, 0.0, 0.2]])
    Y = X @ w.T + np.array([0.1, -0.3])
    Y[::20, 0] += 5.0                        # outliers: absolute error ignores them
    rows = [(X[i].tolist(), [float(Y[i, 0]), None if i % 7 == 0 else float(Y[i, 1])]) for i in range(600)]
    df = spark.createDataFrame(rows, "embedding array<double>, perf array<double>").repartition(4)
    W = np.array([r.theta for r in fit_linear_abs(df, 2, 4, c=100.0, rounds=12).orderBy("net").collect()])
    assert np.allclose(W[:, :4], w, atol=0.05) and np.allclose(W[:, 4], [0.1, -0.3], atol=0.05)


def test_mlp_fits_nonlinear_target(spark):
    import numpy as np
    from routelens.operators.learned import fit_mlp_grid, mlp_scores
    rng = np.random.default_rng(1)
    X = rng.normal(size=(400, 3))
    y = np.abs(X[:, 0]) * 0.5
    df = spark.createDataFrame([(X[i].tolist(), [float(y[i])]) for i in range(400)],
                               "embedding array<double>, perf array<double>").repartition(3)
    configs = [((16, 8), "relu", 0.02)]
    nets = fit_mlp_grid(df, 1, 3, configs, epochs=150)
    scored = mlp_scores(df.withColumn("y", F.col("perf")[0]), nets, configs, 1, 3, "y").collect()
    mse = float(np.mean([(r.scores[0] - r.y) ** 2 for r in scored]))
    assert len(scored) == 400
    assert mse < 0.5 * float(np.var(y))


def test_grouped_fit_equals_separate_fits(spark):
    import numpy as np
    from routelens.operators.learned import fit_linear_abs
    rng = np.random.default_rng(2)
    rows = []
    for g, w in (("a", [0.3, -0.1]), ("b", [-0.2, 0.4])):
        X = rng.normal(size=(200, 2))
        y = X @ np.array(w) + 0.05
        rows += [(g, X[i].tolist(), [float(y[i])]) for i in range(200)]
    df = spark.createDataFrame(rows, "family string, embedding array<double>, perf array<double>").repartition(3)
    both = {r.grp: r.theta for r in fit_linear_abs(df, 1, 2, rounds=5, group="family").collect()}
    for g in ("a", "b"):
        alone = fit_linear_abs(df.where(F.col("family") == g), 1, 2, rounds=5).first().theta
        assert np.allclose(both[g], alone)


def test_list_literal_quotes_and_escapes(spark):
    from routelens.functions.logs import parse_list_literal
    items = ["plain", "it's", 'say "hi"', 'both \' and "', "back\\slash", "line\nbreak", "tab\there", ""]
    lit = str(items)                      # the printed form stored by the surveyed pipeline
    got = spark.createDataFrame([(lit,)], "s string").select(parse_list_literal(F.col("s")).alias("p")).first().p
    assert got == items
    assert spark.createDataFrame([("not a list",)], "s string").select(
        parse_list_literal(F.col("s")).alias("p")).first().p is None


def test_knn_large_distances_use_exact_fallback(spark):
    import random
    rnd = random.Random(5)
    vec = lambda: [rnd.uniform(-1e4, 1e4) for _ in range(4)]
    q = spark.createDataFrame([("g", f"q{i}", vec()) for i in range(20)], "g string, sample_id string, embedding array<double>")
    t = spark.createDataFrame([("g", f"t{i:03d}", vec()) for i in range(80)], "g string, sample_id string, embedding array<double>")
    got = {(r.query_id, r.rank): r.neighbor_id for r in knn_topk(q, t, 3, ["g"], metric="euclidean").collect()}
    tq = {r.sample_id: r.embedding for r in t.collect()}
    for r in q.collect():
        d = sorted((round(-sum((a - b) ** 2 for a, b in zip(r.embedding, v)) ** 0.5, 9), k) for k, v in tq.items())
        d = sorted(d, key=lambda x: (-x[0], x[1]))[:3]
        assert [got[(r.sample_id, i + 1)] for i in range(3)] == [k for _, k in d]


def test_exact_quantile_matches_numpy(spark):
    import numpy as np
    from routelens.operators.quantile import exact_quantile
    rng = np.random.default_rng(4)
    groups = {"cont": rng.normal(size=5000), "ties": rng.choice([0.0, 0.5, 1.0], size=3000),
              "one": np.array([0.3]), "two": np.array([0.1, 0.9]), "zeros": np.zeros(50)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    for q in (0.0, 0.5, 0.95, 1.0):
        got = {r.g: r.quantile for r in exact_quantile(df, "g", "v", q, accuracy=200).collect()}
        for g, vs in groups.items():
            assert math.isclose(got[g], float(np.percentile(vs, q * 100)), rel_tol=1e-12, abs_tol=1e-12), (g, q)


def test_choice_lookup_by_model_index(spark):
    from routelens.operators.routing import with_choice
    ans = "array<struct<model_idx:int,model:string,performance:double,cost_pico:long>>"
    df = spark.createDataFrame([(1, 2, [(0, "a", 0.1, 1), (2, "c", 0.9, 3)])], f"q int, chosen_idx int, answers {ans}")
    r = with_choice(df).first()
    assert (r.chosen, r.performance, r.cost_pico) == ("c", 0.9, 3)
    bad = spark.createDataFrame([(1, 1, [(0, "a", 0.1, 1)])], f"q int, chosen_idx int, answers {ans}")
    with pytest.raises(Exception):
        with_choice(bad).collect()


def test_one_to_one(spark):
    from routelens.operators.reshape import one_to_one
    a = spark.createDataFrame([(1,), (2,), (3,), (3,)], "k int")
    b = spark.createDataFrame([(1,), (2,), (4,)], "k int")
    r = one_to_one(a, b, "k").first()
    assert (r.only_left, r.only_right, r.duplicated) == (1, 1, 1)
    r = one_to_one(b, b, "k").first()
    assert (r.only_left, r.only_right, r.duplicated) == (0, 0, 0)


def test_shipped_price_list(spark):
    from routelens.sources.tables import read_prices_csv
    p = {r.model: (r.prompt_pico, r.completion_pico, r.request_pico) for r in read_prices_csv(spark).collect()}
    assert p["claude-v1"] == (800000, 2400000, None)
    assert p["You.com"] == (1950000, 2600000, 4900000000)
    assert p["meta/code-llama-instruct-34b-chat"] == (77600, 77600, None)
    assert p["no_model_correct"] == (0, 0, None)
    assert p["togethercomputer/llama-2-70b-chat"] == p["meta/llama-2-70b-chat"]


def test_mlp_fit_hangs_neither_on_batches_nor_on_other_groups(spark):
    import numpy as np
    from routelens.operators.learned import fit_mlp_grid, mlp_scores
    rng = np.random.default_rng(9)
    rows = [(g, f"{g}{i}", rng.normal(size=3).tolist(), [float(rng.random()), None if i % 5 == 0 else 1.0])
            for g in ("a", "b") for i in range(1500)]
    df = spark.createDataFrame(rows, "family string, sample_id string, embedding array<double>, perf array<double>")
    configs = [((4,), "relu", 0.01), ((5, 3), "tanh", 0.02)]
    conf, fits = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(conf)
    for rows_a_batch, slices in ((500, 7), (10_000, 2)):
        spark.conf.set(conf, rows_a_batch)
        nets = fit_mlp_grid(df.repartition(slices), 2, 3, configs, epochs=20, group="family", key="sample_id")
        fits.append({(r.grp, r.net): r.theta for r in nets.collect()})
        assert spark.conf.get(conf) == str(rows_a_batch)
    spark.conf.set(conf, before)
    assert fits[0] == fits[1] and len(fits[0]) == 4
    alone = fit_mlp_grid(df.where("family = 'a'"), 2, 3, configs, epochs=20, group="family", key="sample_id")
    assert {(r.grp, r.net): r.theta for r in alone.collect()} == {k: v for k, v in fits[0].items() if k[0] == "a"}
    scored = mlp_scores(df, nets, configs, 2, 3, "sample_id", group="family")
    assert scored.count() == 6000 and scored.select("family", "sample_id", "net").distinct().count() == 6000


def test_training_blocks_hold_every_row_once(spark):
    import numpy as np
    from routelens.operators.learned import _unpacked, training_blocks
    rows = [("a", 1, [float(i), 0.0], [0.5]) for i in range(700)] + [("b", i, [float(i), 1.0], [None]) for i in range(90)] + [("b", 5, None, [1.0])]
    df = spark.createDataFrame(rows, "family string, id int, embedding array<double>, perf array<double>").repartition(5)
    blocks = training_blocks(df, 2, group="family", key="id", block_bytes=16 * 100).collect()      # one hot key: 700 rows
    assert max(b.n for b in blocks) <= 200
    got = sorted((b.grp, *x, *y) for b in blocks for x, y in zip(*_unpacked(b.asDict()), strict=True))
    assert np.array_equal(np.array([g[1:] for g in got]), np.array(sorted((*v, p[0] if p[0] is not None else np.nan) for g, _, v, p in rows if v and g == "a")
                          + sorted((*v, np.nan) for g, _, v, p in rows if v and g == "b")), equal_nan=True)


def test_linear_certificate_shows_optimality(spark):
    import numpy as np
    from routelens.operators.learned import fit_linear_abs, linear_certificate
    rng = np.random.default_rng(4)
    X = rng.normal(size=(500, 4))
    Y = np.stack([X @ [0.3, -0.2, 0.1, 0.4] + 0.2 * rng.normal(size=500), (rng.random(500) < 0.6).astype(float)], axis=1)
    df = spark.createDataFrame([("a", x.tolist(), y.tolist()) for x, y in zip(X, Y, strict=True)], "g string, embedding array<double>, perf array<double>")
    nets = fit_linear_abs(df, 2, 4, group="g")
    good = linear_certificate(df, nets, 2, 4, group="g").collect()
    assert len(good) == 2 and all(-1e-9 <= r.gap < 0.02 and r.rows == 500 for r in good)
    worse = nets.withColumn("theta", F.transform("theta", lambda t: t + 0.3))
    assert all(r.gap > 0.05 for r in linear_certificate(df, worse, 2, 4, group="g").collect())


def test_best_point_all_zero_keeps_cheapest(spark):
    from routelens.operators.results import best_point_per_variant
    df = spark.createDataFrame([("e", 1, 1e-10, 0.0, 50), ("e", 1, 1.0, 0.0, 20), ("e", 1, 10.0, 0.0, 90),
                                ("e", 2, 1e-10, 0.3, 50), ("e", 2, 1.0, 0.5, 70), ("e", 2, 10.0, 0.5, 20)],
                               "eval_name string, v int, willingness_to_pay double, performance double, total_cost long")
    r = {x.v: x for x in best_point_per_variant(df, ["v"]).collect()}
    assert (r[1].performance, r[1].total_cost) == (0.0, 20)                # SD18: cheapest cost
    assert (r[2].performance, r[2].total_cost, r[2].best_willingness_to_pay) == (0.5, 70, 1.0)  # first max by wtp


def test_log_fold_rules(spark):
    import json
    from routelens.operators.logs import fold_events, parse_log_lines
    recs = [
        {"type": "sampling", "sample_id": "s", "data": {"prompt": "Q1 part\n", "sampled": ["r1"]}},
        {"type": "sampling", "sample_id": "s", "data": {"prompt": "Q2\n", "sampled": ["r2"]}},
        {"type": "match", "sample_id": "s", "data": {"correct": False}},
        {"type": "metrics", "sample_id": "s", "data": {"score": 0.25, "choice": "A"}},
        {"type": "sampling", "sample_id": "t", "data": {"prompt": [{"role": "system", "content": ""},
                                                                   {"role": "user", "content": "hi"}],
                                                        "sampled": ["x", "y", "z"]}},
        {"type": "metrics", "sample_id": "t", "data": {"choice": "C"}},
        {"type": "metrics", "sample_id": "u", "data": {"sacrebleu_sentence_score": 42.0}},
    ]
    lines = spark.createDataFrame([("f", i, json.dumps(r)) for i, r in enumerate(recs)], "file string, pos long, line string")
    out = {r.sample_id: r for r in fold_events(parse_log_lines(lines)).collect()}
    assert out["s"].prompt == ["Q1 part\nQ2"]          # completion strings joined, final newline dropped
    assert out["s"].sampled == ["r1"]                 # more than one response: the last is dropped
    assert out["s"].correct == 0.25                   # the last graded event wins
    assert out["t"].prompt == ["hi"] and out["t"].sampled == ["x", "y"]
    assert out["t"].correct == 0.5                    # choice C -> 1 - 2/4
    assert out["u"].correct == 0.42


def test_unknown_model_price_fails(spark):
    from routelens.operators.cost import with_token_cost
    from routelens.operators.routing import price_vectors
    prices = spark.createDataFrame([("a", 1, 2, None)], "model string, prompt_pico long, completion_pico long, request_pico long")
    lengths = spark.createDataFrame([("e", "b", 0, 3.0)], "family string, model string, model_idx int, avg_response_tokens double")
    with pytest.raises(Exception):
        price_vectors(prices, lengths, 1, ["family"]).collect()
    long = spark.createDataFrame([("s", "b", ["p q"], ["r"])], "sample_id string, model string, prompt array<string>, response array<string>")
    with pytest.raises(Exception):
        with_token_cost(long, prices).collect()


def test_hash_embed_tokenless_text_is_zero(spark):
    from routelens.operators.embed import hash_embed
    df = spark.createDataFrame([("a", "Hello world"), ("b", "   "), ("c", "")], "k string, t string")
    r = {x.k: x.embedding for x in hash_embed(df, "t", "k").collect()}
    assert set(r) == {"a", "b", "c"}
    assert all(v == 0.0 for v in r["b"]) and all(v == 0.0 for v in r["c"]) and len(r["b"]) == 32
    assert abs(sum(v * v for v in r["a"]) - 1.0) < 1e-6


def test_ood_all_families_equals_one_at_a_time(spark):
    from routelens.plans.evaluate import knn_routed, prepare
    from routelens.sources.fixtures import model_price, router_samples
    from tests.conftest import SF0001
    rs = router_samples(spark, SF0001)
    fams = sorted(r.family for r in rs.select("family").distinct().collect())[:2]
    cols = ["family", "k", "wtp", "query_id", "chosen"]
    both = knn_routed(prepare(rs, 5, ood_wanted=fams), model_price(spark), ks=[5]).select(*cols).collect()
    one = []
    for f in fams:
        one += knn_routed(prepare(rs, 5, ood_wanted=f), model_price(spark), ks=[5]).select(*cols).collect()
    assert len(both) > 0 and sorted(map(tuple, both)) == sorted(map(tuple, one))


def test_knn_without_groups_plans_no_cartesian(spark):
    q = spark.createDataFrame([("q1", [1.0, 0.0]), ("q2", [0.0, 1.0])], "sample_id string, embedding array<double>")
    t = spark.createDataFrame([("a", [1.0, 0.1]), ("b", [0.1, 1.0]), ("c", [1.0, 1.0])],
                              "sample_id string, embedding array<double>")
    r = knn_topk(q, t, 1, [])
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert {(x.query_id, x.neighbor_id) for x in r.collect()} == {("q1", "a"), ("q2", "b")}


def test_mlp_early_stopping_freezes_converged_nets(spark):
    import numpy as np
    from routelens.operators.learned import fit_mlp_grid
    rng = np.random.default_rng(3)
    rows = [(rng.normal(size=2).tolist(), [0.5]) for _ in range(50)]     # constant target: converges fast
    df = spark.createDataFrame(rows, "embedding array<double>, perf array<double>")
    a = fit_mlp_grid(df, 1, 2, [((4,), "relu", 0.05)], epochs=80, tol=1e-2, n_iter_no_change=2)
    b = fit_mlp_grid(df, 1, 2, [((4,), "relu", 0.05)], epochs=120, tol=1e-2, n_iter_no_change=2)
    assert a.first().theta == b.first().theta and a.first().active == [False]


def test_knn_nan_embedding_is_nobodys_neighbour(spark):
    q = spark.createDataFrame([("g", "q", [0.0, 0.0])], "g string, sample_id string, embedding array<double>")
    t = spark.createDataFrame([("g", "a", [float("nan"), 0.0]), ("g", "b", [1.0, 1.0]), ("g", "c", [3.0, 3.0])],
                              "g string, sample_id string, embedding array<double>")
    r = sorted((x.rank, x.neighbor_id) for x in knn_topk(q, t, 3, ["g"], metric="euclidean").collect())
    assert [n for _, n in r] == ["b", "c"]


def test_knn_cosine_zero_vector_and_nan(spark):
    q = spark.createDataFrame([("g", "q", [1.0, 0.0])], "g string, sample_id string, embedding array<double>")
    t = spark.createDataFrame([("g", "nan", [float("nan"), 1.0]), ("g", "neg", [-1.0, 0.0]),
                               ("g", "zero", [0.0, 0.0]), ("g", "pos", [1.0, 0.1])],
                              "g string, sample_id string, embedding array<double>")
    r = sorted((x.rank, x.neighbor_id) for x in knn_topk(q, t, 4, ["g"]).collect())
    assert [n for _, n in r] == ["pos", "zero", "neg"]


def test_reference_layout_export(spark):
    from routelens.sources.results_io import to_reference_layout
    res = spark.createDataFrame([("e", "knn", 5, 1e-10, 0.5, 2500000000000), ("e", "m0", None, None, 0.25, 10**12)],
                                "eval_name string, router string, neighbors int, wtp double, performance double, "
                                "total_cost_pico long")
    out = {r.model_name: r for r in to_reference_layout(res).collect()}
    assert out["knn"].total_cost == 2.5 and out["knn"].neighbors == 5 and out["knn"].willingness_to_pay == 1e-10
    assert out["m0"].total_cost == 1.0 and out["m0"].neighbors is None and out["m0"].hidden_layer_sizes is None
    assert {"eval_name", "model_name", "performance", "total_cost", "willingness_to_pay",
            "max_cost_per_response"} <= set(to_reference_layout(res).columns)


def test_reading_cost_of_a_huge_corpus(spark):
    from routelens.plans.queries_ingest import reading_cost
    prices = spark.createDataFrame([("dear", 60_000_000, 5_000_000_000), ("cheap", 100_000, None)],
                                   "model string, prompt_pico long, request_pico long")
    got = {r.model: int(r.cost_pico) for r in reading_cost(prices, 10 ** 12, 10 ** 16).collect()}
    assert got == {"dear": 10 ** 16 * 60_000_000 + 10 ** 12 * 5_000_000_000, "cheap": 10 ** 21}
