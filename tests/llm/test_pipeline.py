"""The pipeline's stages, each held against a plain version on its own input."""

import json
from collections import Counter, defaultdict

import corpus_pipeline as P
from routelens.llm import mixing, toxicity
from routelens.session import materialize
from routelens.sources.tables import read_table
from tests.llm.test_exact_dedup import plain
from tests.llm.test_mixing import check
from tests.llm.test_simhash_dedup import brute_components, plain_simhash

SF0001 = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]
    docs = read_table(spark, SF0001, "documents")
    columns, made = docs.columns, []
    for name, stage in P.STAGES:
        made.append(docs)
        docs = materialize(stage(spark, docs, SF0001), "pipeline-test")
        if name != "packing":
            assert docs.columns == columns
    given, clean, unique, apart, mixed = made
    rows = {n: df.collect() for n, df in zip(("given", "clean", "unique", "apart", "mixed"), made, strict=True)}
    ids = {n: [r["doc_id"] for r in x] for n, x in rows.items()}

    rejected = {r["doc_id"] for r in toxicity.toxicity_digest(given, read_table(spark, SF0001, "labels")).where("predicted = 1").collect()}
    assert set(ids["clean"]) == set(ids["given"]) - rejected

    first = {}
    for r in rows["clean"]:
        k = plain(r["text"])
        first[k] = min(first.get(k, r["doc_id"]), r["doc_id"])
    assert sorted(ids["unique"]) == sorted(first.values())

    components = brute_components(ids["unique"], [plain_simhash(r["text"]) for r in rows["unique"]])
    assert set(ids["apart"]) == {i for i, c in zip(ids["unique"], components, strict=True) if i == c}

    digest = mixing.mix_digest(apart).collect()
    check([(r["doc_id"], r["text"], r["source"]) for r in rows["apart"]], digest)
    size = {r["doc_id"]: r["size"] for r in digest}
    taken = Counter(ids["mixed"])
    assert all(taken[r["doc_id"]] * size[r["doc_id"]] == r["taken"] for r in digest)
    texts = {r["doc_id"]: r for r in rows["given"]}
    assert all(r == texts[r["doc_id"]] for r in rows["mixed"])

    bins, pieces = defaultdict(list), Counter()
    for r in docs.collect():
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]] += r["piece"] == 0
    assert pieces == taken
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024


def test_run_and_registration(spark):
    import __spark_entry__ as E
    queries = E.queries()
    assert "pipeline" in queries and all(any(q.startswith(f"op{n}_") for q in queries) for n in range(1, 11))
    out = queries["pipeline"](spark, SF0001)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() > 0
    assert json.dumps(E.oracle_sql())
