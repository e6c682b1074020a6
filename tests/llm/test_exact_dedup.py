"""Exact deduplication against a plain dictionary of normalised texts."""

import hashlib
import re

import numpy as np
import pytest

from routelens.llm import exact_dedup as E
from routelens.sources.tables import read_table

SF0001 = "/root/testdata/sf0.001"


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(plain(t), []).append(i)
    out = []
    for i, t in rows:
        g = groups[plain(t)]
        keep = min((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), hashlib.sha256(plain(t).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("text", ["", " ", "a", " a", "a ", "\t\na  b\x0b\x0cc\r\n", "a\x85b\xa0c  d", "é ß  x", None])
def test_normalise(text):
    assert E.normalise(text) == plain(text).encode()


@pytest.mark.parametrize("n", [0, 1, 2, 50, 5000])
def test_rice_round_trip(n):
    rng = np.random.default_rng(n)
    for universe in (1 << 44, max(n, 1) * 3):
        values = np.unique(rng.integers(0, universe, n))
        blob = E.rice_encode(values, universe)
        assert (E.rice_decode(blob) == values).all() and len(E.rice_decode(blob)) == len(values)
    if n == 5000:
        values = np.unique(rng.integers(0, 1 << 44, n))
        assert len(E.rice_encode(values, 1 << 44)) < n * 4.6  # 44 bits would need 5.5 bytes each


def test_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in read_table(spark, SF0001, "documents").select("doc_id", "text").collect()]
    from routelens.llm.queries import QUERIES
    got = QUERIES["op7_exact_dedup"](spark, SF0001).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == sorted(brute(docs))
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)


@pytest.mark.parametrize("bits", [6, 48])
def test_odd_rows(spark, bits):
    """Null and empty are equal; one row of a repeated id stays; false suspects (6-bit prints) come out unique."""
    rows = [(4, None, "k"), (2, "", "l"), (9, "a  b", None), (7, "a\nb", "m"), (7, "a\nb", "n"), (None, "a b", "o"),
            (None, "only", "p"), (3, "x" * 3_000_000, "q"), (1, " x", "r"), (5, "x", "s")]
    rows += [(100 + i, f"text {i % 90}", "t") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(5).sortWithinPartitions("doc_id")
    df.write.parquet(path := f"/tmp/dedup-test-{bits}-{np.random.default_rng().integers(1 << 40)}")
    df = spark.read.parquet(path)
    got = E.exact_groups(df, bits=bits).select("__row.doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted([(r[0], r[1], r[2], r[4]) for r in got], key=key) == sorted(brute([r[:2] for r in rows]), key=key)
    kept = E.deduplicated(df)
    assert kept.columns == df.columns
    texts = [plain(r["text"]) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({plain(r[1]) for r in rows})


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert E.dedup_digest(df).count() == 0
