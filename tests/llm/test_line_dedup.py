"""Line deduplication against a plain loop over all documents."""

import hashlib
import random

import numpy as np
import pytest

from routelens.llm import line_dedup as L

SPACE = " \t\n\x0b\x0c\r"


def key_of(line, least=10):
    key = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))
    return key if len(key) >= least else None


def plain(rows, least=10):
    """[(doc_id, text)] -> per row (lines, dropped, kept text)."""
    rank = lambda d: (d is None, 0 if d is None else d)
    first = {}
    for d, text in rows:
        for line in (text or "").split("\n"):
            k = key_of(line, least)
            if k is not None:
                first[k] = min(first.get(k, rank(d)), rank(d))
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if (k := key_of(x, least)) is None or first[k] == rank(d)]
        out.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def check(spark, rows, partitions=None, slices=4):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, kept string, h1 int").repartition(slices).cache()
    got = L.line_decisions(df, carry=["doc_id"], partitions=partitions)
    want = sorted(map(repr, plain(rows)))
    found = [(r["__row"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept"] or "") for r in got.collect()]
    assert sorted(map(repr, found)) == want


def test_random_documents(spark):
    rng = random.Random(3)
    pool = [f"line number {i} of the pool" for i in range(40)] + ["  Line Number 3 of the POOL\t", "short", "", "äöüäöüäöüä", "äöüäöüäöü"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 12)))) for i in rng.sample(range(10_000), 300)]
    check(spark, rows)


def test_one_line_in_every_document_spans_tasks(spark):
    rows = [(i, f"the same line everywhere\nown text of {i}, long enough\nthe same line everywhere") for i in range(2000)]
    check(spark, rows, partitions=16)


def test_odd_rows(spark):
    rows = [(5, "repeated line here\nx"), (5, "repeated line here\nx"), (7, "REPEATED LINE HERE  "), (None, "repeated line here"),
            (None, "only without an id\n\n"), (None, "only without an id"), (8, None), (9, ""), (10, "\n\n\n"), (3, "a" * 200_000 + "\nb"),
            (4, "\r\n".join(["a" * 200_000] * 3)), (11, "123456789"), (12, "123456789"), (13, "\x0b1234567890"), (14, "1234567890\x0c")]
    check(spark, rows)
    check(spark, rows, partitions=32, slices=9)


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([(1, "one line of text\nother", 2), (2, "one line of text\nmore", 3), (3, None, 4)], "doc_id long, text string, pos int")
    assert [tuple(r) for r in L.deduplicated_lines(df).orderBy("doc_id").collect()] == [(1, "one line of text\nother", 2), (2, "more", 3), (3, None, 4)]
    assert L.line_digest(df.limit(0)).count() == 0
    assert L.line_digest(df).columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]


def test_string_ids(spark):
    df = spark.createDataFrame([("b", "one line of text"), ("a", "one line of text"), (None, "one line of text")], "doc_id string, text string")
    got = {r["doc_id"]: r["kept_sha256"] for r in L.line_digest(df).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got == {"a": hashlib.sha256(b"one line of text").hexdigest(), "b": empty, None: empty}


@pytest.mark.parametrize("positions", [[0], [7], [8], [1, 2, 900], list(range(5000)), [123456]])
def test_bitmaps_round_trip(positions):
    assert L.from_bits(L.to_bits(np.array(positions))).tolist() == positions


def test_session_keeps_its_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    L.line_digest(spark.createDataFrame([(1, "x")], "doc_id long, text string")).collect()
    assert spark.conf.get(key) == before
