"""SimHash near-duplicates against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash

from routelens.llm import simhash_dedup as S
from routelens.llm.components import star_components
from routelens.sources.tables import read_table

SF0001 = "/root/testdata/sf0.001"


def plain_simhash(text, words=3):
    """The contract read literally."""
    import re
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not found:
        return 0
    grams = [" ".join(found[i:i + words]) for i in range(len(found) - words + 1)] or [" ".join(found)]
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(grams))


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_components(ids, prints, distance=3):
    links = [(i, j) for i in range(len(ids)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= distance]
    root = roots(len(ids), links)
    low = {}
    for i, r in enumerate(root):
        if ids[i] is not None:
            low[r] = min(low.get(r, ids[i]), ids[i])
    return [low.get(r) for r in root]


def test_fingerprint_is_the_contracts():
    for text in [None, "", " \t", "One", "one two", "one two three", "A b  c\nd E f a b c d", "ÀB é ß x y z " * 9,
                 "a\x0bb\x0cc\x85d e f", "wort " * 500]:
        assert S.simhash(text) == plain_simhash(text)


def test_query_equals_brute_force(spark):
    docs = read_table(spark, SF0001, "documents").collect()
    prints = [plain_simhash(r["text"]) for r in docs]
    want = brute_components([r["doc_id"] for r in docs], prints)
    from routelens.llm.queries import QUERIES
    got = {r["doc_id"]: r for r in QUERIES["op5_simhash_dedup"](spark, SF0001).collect()}
    assert len(got) == len(docs)
    for r, p, c in zip(docs, prints, want, strict=True):
        assert (got[r["doc_id"]]["fingerprint"], got[r["doc_id"]]["component_id"]) == (f"{p:016x}", c)


def fingerprint_table(spark, prints):
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    return spark.createDataFrame([(p,) for p in signed], "fp long"), signed


@pytest.mark.parametrize("bucket", [40, 256])
def test_links_join_up_what_all_pairs_join_up(spark, bucket):
    """Random fingerprints, a dense cluster, a chain of steps of three bits, and skewed bits."""
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(300)]
    centre = rng.getrandbits(64)
    flips = rng.sample(range(64), 9)
    prints += [centre ^ sum(1 << b for b in rng.sample(flips, rng.randint(0, 9))) for _ in range(400)]
    step = rng.getrandbits(64)
    for i in range(0, 60, 3):
        step ^= 7 << i
        prints.append(step)
    prints += [rng.getrandbits(24) for _ in range(200)]
    df, signed = fingerprint_table(spark, prints)
    df.write.mode("overwrite").parquet(path := f"/tmp/simhash-test-{bucket}-{rng.getrandbits(40)}")
    got = [(r["a"], r["b"]) for r in S.links(spark.read.parquet(path), 3, bucket).collect()]
    at = {p: i for i, p in enumerate(signed)}
    unsigned = [p % (1 << 64) for p in signed]
    brute = [(i, j) for i in range(len(signed)) for j in range(i) if (unsigned[i] ^ unsigned[j]).bit_count() <= 3]
    assert roots(len(signed), [(at[a], at[b]) for a, b in got]) == roots(len(signed), brute)


def test_plan_uses_every_unit_of_threshold():
    rng = np.random.default_rng(1)
    for total in (10, 10 ** 6, 10 ** 9):
        used = S.plan(rng.integers(0, 1 << 63, 2000).astype(np.uint64), total, 3)
        assert sum(t + 1 for _, t in used) == 4
        seen = [b for g, _ in used for b in g]
        assert len(seen) == len(set(seen))


def test_unequal_thresholds_find_all(spark, monkeypatch):
    """Groups with thresholds 1 and 2 probe neighbouring values."""
    rng = random.Random(6)
    prints = [rng.getrandbits(64) for _ in range(60)]
    prints += [p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for p in prints]
    df, signed = fingerprint_table(spark, prints)
    monkeypatch.setattr(S, "plan", lambda *_: [(list(range(20)), 0), (list(range(20, 41)), 2)])
    got = [(r["a"], r["b"]) for r in S.links(df, 3).collect()]
    at = {p: i for i, p in enumerate(signed)}
    unsigned = [p % (1 << 64) for p in signed]
    brute = [(i, j) for i in range(len(signed)) for j in range(i) if (unsigned[i] ^ unsigned[j]).bit_count() <= 3]
    assert roots(len(signed), [(at[a], at[b]) for a, b in got]) == roots(len(signed), brute)


def test_components(spark):
    rng = random.Random(7)
    links = [(i, i + 1) for i in range(100, 180)] + [(500, i) for i in range(501, 560)]
    links += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(150)]
    links = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in links] * 2
    got = {r["node"]: r["root"] for r in star_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots(1300, links)
    touched = {x for link in links for x in link if link[0] != link[1]}
    assert got == {x: want[x] for x in touched if want[x] != x}
    assert star_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark):
    """Null and wordless texts link with each other at fingerprint zero; repeats, clashing columns, no rows."""
    rows = [(5, None, "x"), (3, "", "y"), (9, " \n", None), (7, "a b c d", "z"), (7, "a b c d", "z"),
            (None, "a b c d", "n"), (4, "q " * 30000, "long")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string").withColumn("fp", df_lit())
    got = [tuple(r) for r in S.simhash_digest(df).collect()]
    assert len(got) == len(rows)
    as_map = {}
    for doc, _, comp in got:
        as_map.setdefault(doc, set()).add(comp)
    assert as_map[5] == as_map[3] == as_map[9] == {3}
    assert as_map[7] == {7} and as_map[None] == {7} and as_map[4] == {4}
    kept = S.one_per_group(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [
        (False, 3), (False, 4), (False, 7)]
    assert S.near_groups(df.limit(0)).count() == 0


def test_one_row_of_each_group(spark):
    """Repeated doc_ids lose near copies only, keep one row of equal ones and never another text."""
    w, v = "one two three four five six", "seven eight nine ten eleven twelve"
    def kept(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string, __id string")
        return sorted(map(tuple, S.one_per_group(df).collect()), key=lambda r: (r[0], r[2]))
    assert kept([(1, w, "a"), (2, w, "b"), (2, v, "c")]) == [(1, w, "a"), (2, v, "c")]
    assert kept([(1, w, "b"), (1, w, "a"), (1, v, "c"), (None, v, "d")]) == [(1, w, "a"), (1, v, "c")]
    assert len(kept([(None, w, "b"), (None, w, None)])) == 1
    near = kept([(5, w, "x"), (5, w + " ", "y"), (9, w, "z")])   # one fingerprint, two texts, one id
    assert len(near) == 1 and near[0][0] == 5
    assert kept([]) == []


def df_lit():
    from pyspark.sql import functions as F
    return F.lit(1)
