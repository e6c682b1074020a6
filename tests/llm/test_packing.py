"""Packing: ids against the tokenizers library, and the rules of a packing on whole tables."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from routelens.llm import packing as P
from routelens.sources.tables import read_table

SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(P.tokenizer_path())
    t.encode_special_tokens = True
    return t


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [P.END]


ODD = ["", " ", "a  b", " a", "a \n b\n\n  c\t d ", "it's we'll 'tis I'M", "x" * 30_000, "ab1-2 ...!? 　 x", "\x1c y\x85 z",
       "日本語 テキスト мир 😀😀 é", "<|endoftext|> end", "10 000,5 %", "\r\n a", "  \n", "é" * 3000 + " q"]


def test_ids_equal_the_tokenizers_library(spark, tokenizer):
    enc = P.Encoder(P.tokenizer_path())
    texts = ODD + [r["text"] for r in read_table(spark, SF0001, "documents").collect()]
    rng = random.Random(3)
    texts += ["".join(rng.choice(" \n\t.'sé1aB-$") for _ in range(40)) for _ in range(500)]
    for t in texts:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == ids_of(tokenizer, t)[:-1], repr(t[:80])
        assert "".join(P.chunks_of(t)) == t


def check_packing(rows, want, capacity=1024):
    """rows: doc_id, piece, start, length, ids_crc32, sequence_id, offset; want: ids by doc_id."""
    bins, parts = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        parts[r["doc_id"]].append(r)
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert set(parts) == set(want)
    for doc, ids in want.items():
        at = 0
        for i, r in enumerate(sorted(parts[doc], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (i, at) and (i == 0 or r["length"] == capacity)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at:at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    return len(bins)


def test_query_on_whole_table(spark, tokenizer):
    from routelens.llm.queries import QUERIES
    docs = {r["doc_id"]: r["text"] for r in read_table(spark, SF0001, "documents").collect()}
    rows = QUERIES["op3_pack"](spark, SF0001).collect()
    want = {k: ids_of(tokenizer, t) for k, t in docs.items()}
    bins = check_packing(rows, want)
    assert bins <= -(-sum(map(len, want.values())) // 1024) * 1.02 + 1


def test_odd_rows_and_sequences(spark, tokenizer):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(900, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = P.pack_documents(df)
    seqs = {r["sequence_id"]: r for r in P.packed_sequences(got).collect()}
    rows_out = got.collect()
    check_packing(rows_out, {i: ids_of(tokenizer, t) for i, t, _ in rows})
    for r in rows_out:
        assert seqs[r["sequence_id"]]["ids"][r["offset"]:r["offset"] + r["length"]] == r["ids"]
    # repeated rows (a mix repeats documents) are packed each
    twice = P.pack_digest(df.where("doc_id in (3, 5)").union(df.where("doc_id in (3, 5)"))).collect()
    assert len(twice) == 4
    assert P.pack_digest(df.limit(0)).count() == 0
    # columns named like the helpers inside come back as they were
    clash = P.token_pieces(df, 1024, P.END, "byte_bpe_50k.json", False).selectExpr(
        "*", "'mine' AS key", "7 AS bucket", "'h' AS h", "'t' AS tie", "'r' AS rank", "'s' AS sequence_id")
    assert {(r["key"], r["bucket"], r["h"], r["tie"], r["rank"]) for r in P.pack(clash).collect()} == {("mine", 7, "h", "t", "r")}
    assert P.pack(clash).columns[-2:] == ["sequence_id", "offset"]


def brute_fullest(lengths, capacity, first):
    """Best total of any sub-multiset with ``first`` in it, by trying all."""
    rest = sorted(lengths)
    rest.remove(first)
    best = 0
    for m in range(1 << len(rest)):
        t = sum(x for i, x in enumerate(rest) if m >> i & 1)
        if t <= capacity - first:
            best = max(best, t)
    return best + first


def test_fullest_is_the_fullest():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.randint(5, 40)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        counts = np.bincount(lengths, minlength=capacity + 1)
        first = max(lengths)
        combo = P.fullest(counts, capacity, first)
        assert all(counts[length] >= n for length, n in combo) and dict(combo).get(first, 0) >= 1
        assert sum(length * n for length, n in combo) == brute_fullest(lengths, capacity, first)


def test_plan_places_every_piece_once():
    rng = random.Random(2)
    counts = {length: rng.choice([1, 2, 3, 50, 100_000]) for length in rng.sample(range(1, 1025), 300)}
    plan = P.slack_plan(counts)
    for length, n in counts.items():
        spans = sorted(zip(*[plan[plan.length == length][c] for c in ("lo", "hi")], strict=True))
        assert spans[0][0] == 0 and spans[-1][1] == n
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    bins = int((plan["bin"] + (plan["hi"] - plan["lo"]) // plan["uses"]).max())
    least = max(sum(k * v for k, v in counts.items()) / 1024, sum(v for k, v in counts.items() if k > 512))
    assert bins <= least * 1.05 + 1
