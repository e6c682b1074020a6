"""Mixing: targets against the contract's resharing loop, copies against plain systematic sampling."""

import re
from collections import defaultdict
from math import ceil

import pytest

from routelens.llm import mixing as M
from routelens.sources.tables import read_table

SF0001 = "/root/testdata/sf0.001"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def reshared_targets(sizes, weights=(5, 2, 1), cap=3):
    """sizes: {source: words}; shares by weight, what is above the cap is reshared until none is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = float(sum(sizes.values())), set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_} if open_ else {}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return {s: float(cap * sizes[s]) if s in full else share[s] for s in names}
        full |= over


def check(rows, got, near=True):
    """rows: (doc_id, text, source); got: digest rows."""
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    target = reshared_targets(dict(sizes))
    source, taken = {i: s for i, _, s in rows}, defaultdict(int)
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((i, words(t)) for i, t, _ in rows)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s], rel=1e-9, abs=1e-9)
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        if r["size"]:
            copies = r["taken"] / r["size"]
            assert copies in (int(rate + 1e-9), ceil(rate - 1e-9)) and copies <= 3
        taken[s] += r["taken"]
    if near:
        for s in sizes:
            largest = max(words(t) for _, t, x in rows if x == s)
            assert abs(taken[s] - target[s]) <= 1.5 * largest + 0.02 * target[s]


def test_query_on_whole_table(spark):
    from routelens.llm.queries import QUERIES
    rows = [tuple(r) for r in read_table(spark, SF0001, "documents").select("doc_id", "text", "source").collect()]
    got = QUERIES["op4_mix"](spark, SF0001).collect()
    check(rows, got)
    again = QUERIES["op4_mix"](spark, SF0001).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_partitioning_changes_nothing(spark):
    docs = read_table(spark, SF0001, "documents")
    one = sorted(map(tuple, M.mix_digest(docs.repartition(1)).collect()))
    assert one == sorted(map(tuple, M.mix_digest(docs.repartition(13, "lang")).collect()))


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 7}, {"x": 0, "y": 0}, {"only": 50},
                                   {chr(97 + i): 3 ** i for i in range(12)}, {"é": 5, "z": 9, "Z": 2, "": 4}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r["source"]: r["target"] for r in M.source_targets(df).collect()}
    want = reshared_targets(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s], rel=1e-9, abs=1e-9)


def test_odd_rows(spark):
    """Null texts and sources, empty texts, a hot source of equal texts, repeats, clashing columns."""
    rows = [(i, "a b c", "hot") for i in range(700)] + [(1000 + i, f"w{i} " * (i + 1), "s%d" % (i % 3)) for i in range(40)]
    rows += [(2000, None, "s1"), (2001, "", None), (2002, "x y", None), (2003, "z " * 100_000, "long")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, key int")
    check(rows, M.mix_digest(df).collect())
    out = M.mixed_documents(df.union(df.where("doc_id = 2003")))
    assert out.columns == df.columns
    assert M.mix_digest(df.limit(0)).count() == 0
    assert M.mixed_documents(df.limit(0)).count() == 0
