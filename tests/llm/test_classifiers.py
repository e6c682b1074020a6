"""Toxicity and quality: held-out accuracy, the parts against plain versions, odd rows."""

import zlib

import numpy as np
import pandas as pd
import pytest

from routelens.llm import quality as Q
from routelens.llm import toxicity as X
from routelens.llm.trees import fit_boosted, isotonic
from routelens.sources.tables import read_table

SF001 = "/root/testdata/sf0.01"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    for v in np.unique(score):
        ranks[score == v] = np.flatnonzero(score[order] == v).mean() + 1
    p, n = y.sum(), (1 - y).sum()
    return (ranks[y == 1].sum() - p * (p + 1) / 2) / (p * n)


@pytest.mark.parametrize("name, label, threshold, least", [("op1_toxicity", "toxic", 0.5, 0.85), ("op6_quality", "quality", 0.3, 0.95)])
def test_held_out(spark, name, label, threshold, least):
    from routelens.llm.queries import QUERIES
    got = QUERIES[name](spark, SF001).collect()
    assert len(got) == read_table(spark, SF001, "documents").count()
    labels = {r["doc_id"]: r[label] for r in read_table(spark, SF001, "labels").collect()}
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    y = np.array([labels[r["doc_id"]] for r in held])
    assert auc(np.array([r["score"] for r in held]), y) >= least
    wrong = sum(r["predicted"] != v for r, v in zip(held, y, strict=True))
    assert wrong <= 0.08 * len(held)


def test_labels_of_held_out_rows_are_not_used(spark):
    docs, labels = read_table(spark, SF001, "documents"), read_table(spark, SF001, "labels")
    from pyspark.sql import functions as F
    flipped = labels.withColumn("quality", F.when(X.fold_of(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r["doc_id"], round(r["score"], 9)) for r in Q.quality_digest(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def test_isotonic_equals_plain_pooling():
    rng = np.random.default_rng(3)
    m = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-2 * m))).astype(float)
    knots, p = isotonic(m, y)
    assert (np.diff(knots) > 0).all() and (np.diff(p) >= 0).all() and 0 < p[0] and p[-1] < 1
    # the fit by the min-max formula, before the pull towards a half
    s = y[np.argsort(m)]
    c = np.concatenate([[0], np.cumsum(s)])
    fit = [max(min((c[j] - c[i]) / (j - i) for j in range(k + 1, 401)) for i in range(k + 1)) for k in range(0, 400, 40)]
    got = np.interp(np.sort(m)[::40], knots, p)
    assert np.abs(got - fit).max() < 0.3


def test_boosted_trees_learn_an_interaction():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = fit_boosted(x[:2000], y[:2000])
    assert ((model.margin(x[2000:]) > 0) == (y[2000:] == 1)).mean() > 0.95
    assert model.margin(x[:0]).shape == (0,)


def test_discriminant_equals_log_densities():
    """Without shrinkage the difference is that of two fitted normal log densities."""
    rng = np.random.default_rng(5)
    d = len(Q.STATISTICS)
    data = {c: rng.normal(size=(500, d)) @ (np.eye(d) + 0.2 * rng.normal(size=(d, d))) + 0.5 * c for c in (0, 1)}
    moments = {}
    for c, x in data.items():
        one = np.hstack([np.ones((500, 1)), x])
        moments[c] = one.T @ one
    model = Q.discriminant(moments, 0.0, 0.0)
    x = rng.normal(size=(20, d))
    z = (x - model.shift) / model.scale

    def log_density(c):
        t = (data[c] - model.shift) / model.scale
        diff, cov = z - t.mean(axis=0), np.cov(t.T, bias=True)
        return -0.5 * (diff @ np.linalg.inv(cov) * diff).sum(axis=1) - 0.5 * np.linalg.slogdet(cov)[1]

    near = (np.abs(z) < 8).all(axis=1)
    assert np.allclose(model.difference(x)[near], (log_density(1) - log_density(0))[near])


def test_word_flags():
    codes = X.Codes(frozenset({"idiot", "moro*"}), frozenset({"silly"}))
    assert codes["Idiot!"] & X.HIT and codes["Idiot!"] & X.LOUD
    assert codes["1d10t"] & X.UNMASKED and codes["iiiidiooot"] & X.STRETCHED
    assert codes["moronic"] & X.HIT and codes["silly,"] & X.MILD and codes["YOU"] & X.YOU and codes["YOU"] & X.SHOUT
    assert codes["tree"] == 0 and codes["..."] == 0
    near = dict(zip(X.FEATURES, X.features("you are an idiot", codes), strict=True))
    far = dict(zip(X.FEATURES, X.features("you " + "x " * 50 + "idiot", codes), strict=True))
    assert near["you_near"] == 1 and far["you_near"] == 0 and near["you_gap"] > far["you_gap"]


ODD = [(1, None), (2, ""), (3, " \n"), (None, "you idiot"), (4, "é" * 300_000), (5, "w " * 100_000), (5, "w " * 100_000), (6, "a\x00b")]


@pytest.mark.parametrize("digest, label", [(X.toxicity_digest, "toxic"), (Q.quality_digest, "quality")])
def test_odd_rows(spark, digest, label):
    docs = spark.createDataFrame([(*r, 0.5, "z") for r in ODD], "doc_id long, text string, score double, fold string")
    empty = spark.createDataFrame([], f"doc_id long, {label} int")
    got = digest(docs, empty).collect()
    assert len(got) == len(ODD) and len({r["score"] for r in got}) == 1
    assert not [r for r in got if r["doc_id"] is None][0]["held_out"]
    real = read_table(spark, SF001, "documents").select("doc_id", "text")
    labels = read_table(spark, SF001, "labels").select("doc_id", label)
    labels = labels.union(spark.createDataFrame([(None, 1), (7, None), (8, 1), (8, 0)], f"doc_id long, {label} int"))
    both = real.union(docs.select("doc_id", "text"))
    got = digest(both, labels).collect()
    assert len(got) == real.count() + len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert digest(docs.limit(0), labels).count() == 0


def test_keep_clean_keeps_the_columns(spark):
    docs, labels = read_table(spark, SF001, "documents"), read_table(spark, SF001, "labels")
    kept = X.keep_clean(docs, labels)
    assert kept.columns == docs.columns
    scores = {r["doc_id"]: r["predicted"] for r in X.toxicity_digest(docs, labels).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {i for i, p in scores.items() if not p}


def test_toxic_texts_that_share_a_pair_all_count(spark):
    """Only copies count once: not one-word texts, nor texts that merely share their lowest-hashed pair."""
    insults = [f"grolk{chr(97 + i)}" for i in range(6)]
    common = min((f"w{i} w{i + 1}" for i in range(400)), key=lambda p: zlib.crc32(p.encode()))
    long = [" ".join([common, *(f"grolk{n}x{i}" for i in range(60))]) for n in range(6)]
    key = X._sketch(pd.Series([*insults, *long, insults[0].upper(), long[0].upper()]))
    assert key.nunique() == 12 and key[0] == key[12] and key[6] == key[13]
    rows = [(t, 1) for t in insults + long] + [(f"clean{i} words{i} here", 0) for i in range(200)]
    strong, mild = X.learn_lexicon(spark.createDataFrame(rows, "text string, y int"))
    assert "grolk*" in strong | mild  # five letters of twelve texts; one of the one-word texts alone counted before
    one_word, _ = X.learn_lexicon(spark.createDataFrame([(t, 1) for t in insults] + rows[12:], "text string, y int"))
    assert "grolk*" in one_word


def test_word_flags_equal_plain_ones_whatever_the_cache():
    import random

    from routelens.llm import toxicity as X
    strong, mild = frozenset(["idiot", "stup*", "trash"]), frozenset(["bad", "sill*", "trash*", "stupi*"])

    def plain(word):
        code, low = 0, X.bare(word)
        if low:
            for flag, terms in ((X.HIT, strong), (X.MILD, mild)):
                if not code and any(t in terms for t in X.terms_of(low)):
                    code |= flag
            code |= X.YOU if low in X.ADDRESS else 0
            whole = low.translate(X.LOOKALIKE)
            whole = "".join(c for i, c in enumerate(whole) if i < 2 or not c == whole[i - 1] == whole[i - 2])
            if whole != low:
                if not code & X.HIT and any(t in strong for t in X.terms_of(whole)):
                    code |= X.HIT | X.UNMASKED
                code |= X.STRETCHED if low.isalpha() else 0
        code |= X.SHOUT if len(low) > 2 and word.isupper() else 0
        if low and not low.isalpha() and any(c.isalpha() for c in low) and not low.isalnum() or low[:1].isalpha() and any(c.isdigit() for c in low):
            code |= X.ODD
        return code | (X.LOUD if word[-1:] == "!" else 0)

    rng = random.Random(1)
    words = ["idiot", "1d10t!", "stupid", "STUPID!!", "stuuupid", "trashy", "trash", "silly", "bad", "you", "a-b", "x2", "!!!", "", "Tú", "ßß"]
    words += ["".join(rng.choice("stupid10!a$") for _ in range(rng.randrange(1, 9))) for _ in range(500)]
    for limit in (1, 7, 10_000):
        codes = X.Codes(strong, mild, limit)
        for w in words + words[::-1]:
            assert codes[w] == plain(w), w
        assert len(codes) <= limit and len(codes.older) <= limit
