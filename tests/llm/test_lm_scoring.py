"""LM scores: exact base counts against brute force; the mixed model is a probability and learns."""

import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from routelens.llm import lm_scoring as L
from routelens.sources.tables import read_table

SF0001 = "/root/testdata/sf0.001"
END = object()


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), END]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def brute_base(rows):
    """held_out, n_tokens, n_known, train_tokens, base_score per row."""
    c = Counter(t for i, x in rows if not held(i) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), n,
             sum(log10((c[t] + 1) / (n + v + 1)) for t in tokens(x))) for i, x in rows]


def compare(rows, got):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    want = sorted(brute_base(rows), key=key)
    have = sorted([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"])
                   for r in got], key=key)
    assert [w[:5] for w in want] == [h[:5] for h in have]
    assert [w[5] for w in want] == pytest.approx([h[5] for h in have], rel=1e-9)


@pytest.mark.parametrize("common", [50, 200_000])
def test_base_score_equals_brute_force(spark, common):
    docs = read_table(spark, SF0001, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = L.lm_scores(docs, bits=14, common_words=common).collect()
    compare(rows, got)
    assert all(-1e7 < r["score"] < 0 for r in got)


def test_query_scores_whole_table(spark):
    from routelens.llm.queries import QUERIES
    got = QUERIES["op9_lm_score"](spark, SF0001).collect()
    assert len(got) == read_table(spark, SF0001, "documents").count()
    out = [r for r in got if r["held_out"]]
    assert out and not any(np.isnan(r["score"]) for r in got)
    # far better than eight bits a byte on texts it has not seen
    texts = {r["doc_id"]: r["text"] for r in read_table(spark, SF0001, "documents").collect()}
    size = sum(len(b" ".join(L.words_of(texts[r["doc_id"]]))) + 2 for r in out)
    assert -sum(r["score"] for r in out) / log10(2) / size < 4.0


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "x y"), (4, "a \x00 b"), (4, "a \x00 b"), (5, "é" * 200_000),
            (6, "W w " * 50_000), (7, "日本 😀")]
    df = spark.createDataFrame([(*r, 1.0, "z") for r in rows], "doc_id long, text string, score double, word string")
    got = L.lm_scores(df, bits=14).collect()
    compare(rows, got)
    assert L.lm_scores(df.limit(0), bits=14).count() == 0
    only_held = [(i, "a b") for i in range(60) if held(i)]
    got = L.lm_scores(spark.createDataFrame(only_held, "doc_id long, text string"), bits=14).collect()
    compare(only_held, got)


def model_blocks(units, blocks=1):
    """What the buckets answer to ``units`` (dict of counts) cut into ``blocks`` blocks, without Spark's shuffles."""
    keys, out = sorted(units, key=lambda u: u[4:]), []
    parts = [keys[i::blocks] for i in range(blocks)]
    pairs = [L.Decisions(p).keys() for p in parts]
    every, at = L.distinct(np.concatenate([p.ravel() for p in pairs]))
    n = np.bincount(at, np.concatenate([np.tile(np.array([units[u] for u in p])[L.Decisions(p).unit], L.CONTEXTS) for p in parts]),
                    len(every)).astype(np.int64)
    five, rare, more = L.outcomes(every, n)
    for p, pair in zip(parts, pairs, strict=True):
        own = np.isin(every, pair)
        out.append((L.pack(p, np.array([units[u] for u in p])), L.planes(five[:, own]), L.planes(more[:, own[rare]])))
    return out


def plain_decisions(units):
    """(unit, level, contexts as bytes with the bits before, bit) by a loop over bytes."""
    for u in sorted(units, key=lambda u: u[4:]):
        text = u + b" "
        for i in range(4, len(text)):
            before = text[4:i]
            contexts = [("word", before), ("two", text[i - 2:i]), ("three", text[i - 3:i]),
                        ("five", text[i - 5:i] if i > 4 else text[:i]), ("kind", u[2:3], before)]
            code = L.SYMBOLS.find(text[i:i + 1])
            path = format(31 if code < 0 else code, "05b") + (format(text[i], "08b") if code < 0 else "")
            for j, bit in enumerate(path):
                yield u, j, [(c, path[:j]) for c in contexts], int(bit)


def plain_model(units):
    """Counts, weights and map learned, and all units scored, one decision at a time."""
    counts, steps = Counter(), {}
    for u, j, contexts, bit in plain_decisions(units):
        steps.setdefault(j, []).append((u, contexts, bit))
        for k, c in enumerate(contexts):
            counts[k, c, bit] += units[u]

    def look(contexts, bit, less):
        pairs = [[counts[k, c, b] - (less if b == bit else 0) for b in (0, 1)] for k, c in enumerate(contexts)]
        known = [min(7, int(np.ceil(np.log2(sum(pairs[k]) + 1)))) for k in (0, 3)]
        return [np.log((b + 0.4) / (a + 0.4)) for a, b in pairs], known[0] * 4 + (known[1] > 2) * 2

    step = lambda z: min(max(int(np.rint(z * 2)) + L.STEPS // 2, 0), L.STEPS - 1)
    w, power, refine = L.start_weights(), np.full((L.GATES, L.CONTEXTS), 1e-3), np.zeros((L.GATES, L.STEPS, 2))
    for j in sorted(steps):
        grad, total = np.zeros((L.GATES, L.CONTEXTS)), np.ones(L.GATES)
        for u, contexts, bit in steps[j]:
            if units[u]:
                odds, gate = look(contexts, bit, 1)
                gate += j > 0
                z = float(w[gate] @ odds)
                grad[gate] += (bit - 1 / (1 + np.exp(-z))) * units[u] * np.array(odds)
                total[gate] += units[u]
                refine[gate, step(z), bit] += units[u]
        grad /= total[:, None]
        power += grad ** 2
        w = w + 0.04 * grad / np.sqrt(power)
    scores = Counter()
    for j in sorted(steps):
        for u, contexts, bit in steps[j]:
            odds, gate = look(contexts, bit, 0)
            gate += j > 0
            z = float(w[gate] @ odds)
            zero, one = refine[gate, step(z)]
            centre = 1 / (1 + np.exp(-(step(z) - L.STEPS // 2) / 2))
            p = 0.5 / (1 + np.exp(-z)) + 0.5 * (one + 4 * centre) / (zero + one + 4)
            scores[u] += np.log10(p if bit else 1 - p)
    return w, refine, scores


TEXTS = ["the cat and the hat, the end", "a Zebra's caf\u00e9! 99 naïve cats?", "sat on the mat the cat"]


def training(texts, others=()):
    units = Counter(u for t in texts for u in L.units_of(L.words_of(t)))
    return {**dict.fromkeys(others, 0), **units}


def test_model_equals_a_loop_over_bytes(spark):
    """Weights, map and scores of the distributed path against one decision at a time."""
    units = training(TEXTS * 5, [L.START + b"unseen", L.KINDS[97] + "日".encode()])
    w, refine, scores = plain_model(units)
    df = spark.createDataFrame([(bytes(u), n) for u, n in units.items()], "unit binary, n long")
    one = spark.createDataFrame(model_blocks(units), "units binary, five binary, rare binary")
    got = L.taught(one)
    assert got.weights == pytest.approx(w, abs=1e-4)
    centre = 1 / (1 + np.exp(-(np.arange(L.STEPS) - L.STEPS // 2) / 2))
    assert got.refine.reshape(L.GATES, L.STEPS) == pytest.approx((refine[:, :, 1] + 4 * centre) / (refine.sum(axis=2) + 4), abs=1e-4)
    found = {bytes(r["unit"]): r["score"] for r in one.mapInArrow(L._log10(spark.sparkContext.broadcast(got)),
                                                                "unit binary, n long, score double").collect()}
    assert found == {u: pytest.approx(x, rel=1e-3) for u, x in scores.items()}
    # the whole job, in one partition: one block, answered by 2^n buckets
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        whole = {bytes(r["unit"]): r["score"] for r in L.score_units(df, bits=6).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert whole == {u: pytest.approx(x, rel=1e-3) for u, x in scores.items()}


def test_words_share_one(spark):
    """The probabilities of different words after one kind sum to one at most, and nearly one over those seen."""
    words = {L.START + w: n for w, n in ((b"the", 500), (b"cat", 300), (b"hat", 200), (b"then", 100))}
    rare = {L.START + bytes([b]): 0 for b in range(256) if b not in b" \t\n\x0b\f\r"}
    got = L.score_units(spark.createDataFrame([(u, n) for u, n in {**rare, **words}.items()], "unit binary, n long"), bits=8).collect()
    share = {bytes(r["unit"]): 10 ** r["score"] for r in got}
    assert len(share) == len(words) + len(rare) and sum(share.values()) <= 1.0001
    assert sum(share[u] for u in words) > 0.8


def test_learns_and_sums_agree(spark):
    """Seen words score far above others; weights taught by several tasks are the same in any order of rows."""
    units = training(["the cat sat on the mat"] * 50, [L.START + b"xqz"])
    blocks = model_blocks(units, 5)
    a, b = (L.taught(spark.createDataFrame(rows, "units binary, five binary, rare binary").repartition(5)) for rows in (blocks, blocks))
    assert (a.weights == b.weights).all() and (a.refine == b.refine).all()
    got = {bytes(r["unit"]): r["score"] for r in L.score_units(
        spark.createDataFrame([(bytes(u), n) for u, n in units.items()], "unit binary, n long"), bits=8).collect()}
    assert got[L.START + b"the"] > got[L.START + b"xqz"] + 2


def test_commonest_is_bounded_by_count(spark):
    """No sort: the least count that few enough units reach; long units are never among them."""
    rows = [(f"{i:04d}".encode(), 9000 + i) for i in range(50)] + [(b"x%d" % i, 3) for i in range(30)] + [(b"y" * 100, 10 ** 12)]
    df = spark.createDataFrame(rows, "unit binary, n long")
    assert L.commonest(df, 1000).count() == 80
    assert L.commonest(df, 79).count() == 50
    few = [r["n"] for r in L.commonest(df, 20).collect()]
    assert len(few) <= 20 and all(n >= max(9049 - 50, 0) for n in few)
    assert L.commonest(df, 0).count() == 0 and L.commonest(df.limit(0), 5).count() == 0


def test_context_counts_are_exact_and_grow(spark):
    """The counts behind each decision are those of its own context alone, however many contexts there
    are (in 2^14 slots a context most of these were mixed)."""
    rng = np.random.default_rng(1)
    units = sorted({L.START + bytes(w) for w in rng.integers(97, 123, (30_000, 6)).astype(np.uint8)} | {L.START + "é日".encode()})
    n = rng.integers(1, 5, len(units))
    want = Counter()
    for u, times in zip(units, n.tolist(), strict=True):
        for i in range(4, len(u) + 1):
            want[u[4:i], (u + b" ")[i]] += times
    d = L.Decisions(units)
    keys, at = np.unique(d.keys(), return_inverse=True)
    at = at.reshape(L.CONTEXTS, -1)
    pairs = [(u[4:i], (u + b" ")[i]) for u in units for i in range(4, len(u) + 1)]
    assert len(set(at[0].tolist())) == len(want)
    df = spark.createDataFrame([(u, int(x)) for u, x in zip(units, n, strict=True)], "unit binary, n long")
    asked = df.repartition(3).mapInArrow(L._ask(4), L.ASKED)
    got = asked.repartition(4, "bucket").sortWithinPartitions("bucket").mapInArrow(L._answer, L.ANSWERED)
    blocks = got.repartition(2, "block").sortWithinPartitions("block", "bucket").mapInArrow(L._gather, "units binary, five binary, rare binary")
    seen = 0
    after = Counter()  # (prefix, first bit of the next symbol)
    for (p, b), times in want.items():
        after[p, int(L.CODE[b]) >> 4] += times
    for r in blocks.collect():
        part, own = L.unpack(bytes(r["units"]))
        seen += int(own.sum())
        mine = [u[4:i] for u in part for i in range(4, len(u) + 1)]
        j, _, _, odds, known = next(L.decisions_of(part, bytes(r["five"]), bytes(r["rare"])))
        pair = np.array([(after[p, 0], after[p, 1]) for p in mine], dtype=np.float32)
        assert j == 0 and odds[0] == pytest.approx(L.log_odds(pair[:, 0], pair[:, 1]), abs=1e-5)
        assert known[0].tolist() == L.confidence(pair.sum(axis=1)).tolist()
    assert seen == n.sum() and len(pairs) == at.shape[1]


def test_score_does_not_hang_on_a_table_size(spark):
    docs = read_table(spark, SF0001, "documents").limit(60).coalesce(1)
    a, b = (sorted((r["doc_id"], r["score"]) for r in L.lm_scores(docs, bits=bits).collect()) for bits in (8, 20))
    assert [x[1] for x in a] == pytest.approx([x[1] for x in b], rel=1e-6)


@pytest.mark.parametrize("size", [50, 70_000])
def test_every_block_teaches(spark, size):
    """Also a task with two blocks only; the kind before a word with the word so far is a context."""
    rng = np.random.default_rng(2)
    units = sorted({k + bytes(w) for k in (L.START, L.KINDS[97]) for w in rng.integers(97, 123, (size // 2, 5)).astype(np.uint8)})
    blocks = (spark.createDataFrame([(u, 3) for u in units], "unit binary, n long").coalesce(1).sortWithinPartitions("unit")
              .mapInArrow(L._ask(0), L.ASKED).coalesce(1).sortWithinPartitions("bucket").mapInArrow(L._answer, L.ANSWERED)
              .coalesce(1).sortWithinPartitions("block", "bucket").mapInArrow(L._gather, "units binary, five binary, rare binary"))
    rows = blocks.collect()
    assert len(rows) == -(-len(units) // L.STEP_UNITS)
    (taught,) = blocks.coalesce(1).mapInArrow(L._teach, "numbers array<double>").collect()
    numbers, cut = np.array(taught["numbers"]), L.GATES * L.CONTEXTS
    weights = numbers[:cut].reshape(L.GATES, L.CONTEXTS) / numbers[cut]
    assert numbers[cut] == 3 * len(units) and np.abs(weights - L.start_weights()).max() > 0.01
    decided = 3 * sum(5 if L.CODE[b] < 31 else 13 for u in units for b in u[4:] + b" ")
    assert numbers[cut + 1:].sum() == decided  # the map counts every decision of every occurrence
    d = L.Decisions([L.START + b"ab", L.KINDS[97] + b"ab"])
    keys = d.keys()
    assert L.CONTEXTS == 5 and (keys[0, :3] == keys[0, 3:]).all() and (keys[4, :3] != keys[4, 3:]).all()
