"""Language-model scores by logistic mixing of hashed-context bit predictors.

The text is the stream of its lower-cased words, one space after each, and an end mark.  A symbol is
five binary decisions for the commonest bytes and thirteen for the rest.  For every decision the
contexts (the word so far; the last two, three and five bytes, which at a word's start include the kind
of byte that ended the word before; that kind with the word so far) give counts of both outcomes; the log odds of the predictions are
mixed by a weight vector that a gate chooses (how well the contexts are known, and the level), and an
adaptive probability map refines the mix.

A unit is a word with the kind before it, and all contexts of its bytes lie inside it: no context
crosses a word border.  The counts are those of all training units and no two contexts share them: a
context is a 51-bit hash.  Sorted blocks of units ask for the counts of their distinct (context, byte)
pairs; buckets, as many as the counted positions need, add up what all blocks hold of a pair and
answer each block.  So the table grows with the corpus and no task holds more than a bucket of it.

Weights and map learn online, block by block within a task, each decision predicted from the counts
without its own occurrence; every block with training units teaches.  Tasks' weights are averaged, in
one job whose sums do not hang on the order in which tasks end.

A unigram base score is computed beside it with exact counts.  The commonest units travel to the
scoring tasks with their scores (at most ``COMMON_WORDS`` of at most ``COMMON_BYTES`` bytes, chosen by a
count that few enough units reach), all others are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import compress, pairwise, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelens.llm.common import bounded_batches
from routelens.session import materialize

#: A bucket of the context table answers for about 2^BITS positions.
BITS = 20
#: Distinct units gathered before a task sends them, and units of a block: the larger, the fewer pairs
#: are asked for more than once.
UNITS = 300_000
STEP_UNITS = 60_000
#: Words of a group of documents scored together.
GROUP_WORDS = 100_000
#: Units whose scores and counts travel to the scoring tasks: how many at most, and their length.
COMMON_WORDS, COMMON_BYTES = 250_000, 64
FOLDS, HELD_OUT = 7, 2
CONTEXTS, GATES, STEPS = 5, 32, 33
END = b" "  # no word

# The bytes with five-decision codes.
SYMBOLS = b" etaoinshrdlucmfwypvbgkjqxz.,|\xc3"
CODE = np.full(256, 31, dtype=np.uint32)
CODE[list(SYMBOLS)] = np.arange(len(SYMBOLS))
ROLL64 = np.random.default_rng(43).integers(0, 1 << 63, 1024).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: The 13 low bits of a key: a byte's code of five bits and, for the bytes without one, the byte.
PATH = np.where(CODE == 31, 31 << 8 | np.arange(256), CODE << 8).astype(np.uint64)
PATH_BITS = 13


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def _kind(byte: int) -> bytes:
    """The four bytes before a word: padding, what kind of byte ended the word before, a space."""
    c = chr(byte)
    return b"\0\0" + (b"a" if byte > 127 or c.isalnum() else b"." if c in ".!?" else b",") + b" "


KINDS = [_kind(b) for b in range(256)]
START = b"\0\0\n "


def units_of(words: list[bytes]) -> list[bytes]:
    """A unit per word and one for the end: the four bytes of the kind before, then the word."""
    return list(map(bytes.__add__, [START, *[KINDS[w[-1]] for w in words]], [*words, END]))


class Decisions:
    """All binary decisions of a list of units, level by level."""

    def __init__(self, units: list[bytes]):
        sizes = np.fromiter(map(len, units), dtype=np.int64, count=len(units)) + 1
        by = np.frombuffer(b" ".join(units) + b" ", dtype=np.uint8)
        starts = np.cumsum(sizes) - sizes
        unit = np.repeat(np.arange(len(units), dtype=np.int32), sizes)
        pos = np.arange(len(by), dtype=np.int64) - starts[unit]
        at = np.flatnonzero(pos >= 4)
        self.unit, self.symbol, self.byte = unit[at], CODE[by[at]], by[at].astype(np.uint32)
        self._bytes, self._starts, self._pos, self._at = by, starts, pos, at

    def keys(self) -> np.ndarray:
        """(context, position): the hash of the context, and in the low bits the path of the byte."""
        at, wide = self._at, self._bytes.astype(np.uint64)
        pos = self._pos.astype(np.uint64)
        rolled = np.cumsum((wide + np.uint64(1)) * ROLL64[self._pos & 1023] * ((pos >> np.uint64(10)) * np.uint64(2) + np.uint64(1)))
        prefix = rolled[at - 1] - rolled[self._starts + 3][self.unit]
        two = wide[at - 1] | wide[at - 2] << np.uint64(8)
        three = two | wide[at - 3] << np.uint64(16)
        fifth = np.where(self._pos[at] > 4, wide[at - 5], np.uint64(0))
        five = three | wide[at - 4] << np.uint64(24) | fifth << np.uint64(32)
        kind = prefix + spread(wide[self._starts + 2], CONTEXTS)[self.unit]
        path = PATH[self._bytes[at]]
        return np.stack([spread(c, k) >> np.uint64(PATH_BITS) << np.uint64(PATH_BITS) | path
                         for k, c in enumerate([prefix, two, three, five, kind])])

    def levels(self) -> Iterator[tuple]:
        """(level, units, bit) of each level."""
        for j in range(5):
            yield j, self.unit, (self.symbol >> np.uint32(4 - j)) & np.uint32(1)
        rare = np.flatnonzero(self.symbol == 31)
        if len(rare):
            unit, byte = self.unit[rare], self.byte[rare]
            for j in range(8):
                yield j + 5, unit, (byte >> np.uint32(7 - j)) & np.uint32(1)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, sorted, and where each value is among them (hashed: few repeat often)."""
    codes, found = pd.factorize(values.ravel())
    order = np.argsort(found)
    rank = np.empty(len(found), dtype=np.int32)
    rank[order] = np.arange(len(found), dtype=np.int32)
    return found[order], rank[codes].reshape(values.shape)


def spread(context: np.ndarray, k: int) -> np.ndarray:
    """64 well-mixed bits of the k-th context; a bijection for each k."""
    h = context + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def log_odds(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + np.float32(0.4)) / (n0 + np.float32(0.4))).astype(np.float32)


def confidence(n: np.ndarray) -> np.ndarray:
    """0 to 7 by how often a context was seen: each step doubles."""
    return np.minimum(np.ceil(np.log2(n.astype(np.float32) + np.float32(1))), 7).astype(np.uint8)


def gate_of(word: np.ndarray, five: np.ndarray, level: int) -> np.ndarray:
    return word.astype(np.int64) * 4 + (five > 2) * 2 + int(level > 0)


def start_weights() -> np.ndarray:
    """The better the word so far is known, the more it counts."""
    trust = np.arange(GATES) // 4 / 7
    return np.stack([0.1 + 0.8 * trust, *[0.3 * (1 - trust)] * 3, 0.1 + 0 * trust], axis=1)


class Mixer:
    """Weights and map, learned online."""

    def __init__(self):
        self.weights, self.power = start_weights(), np.full((GATES, CONTEXTS), 1e-3)
        self.map = np.zeros((GATES, STEPS, 2))
        self.seen = 0.0

    def teach(self, odds: list, known: list, level: int, bit: np.ndarray, n: np.ndarray) -> None:
        gate = gate_of(known[0], known[1], level)
        w = self.weights.astype(np.float32)
        z = sum(w[gate, k] * odds[k] for k in range(CONTEXTS))
        weight = n.astype(np.float32)
        error = (bit - 1 / (1 + np.exp(-np.clip(z, -15, 15)))) * weight
        total = np.bincount(gate, weight, GATES) + 1.0
        grad = np.stack([np.bincount(gate, error * odds[k], GATES) for k in range(CONTEXTS)], axis=1) / total[:, None]
        self.power += grad ** 2
        self.weights += 0.04 * grad / np.sqrt(self.power)
        cell = (gate * STEPS + step_of(z)) * 2 + bit
        self.map += np.bincount(cell, weight, GATES * STEPS * 2).reshape(GATES, STEPS, 2)

    def numbers(self) -> np.ndarray:
        """Weights times what was seen, what was seen, and the map: sums over tasks."""
        return np.concatenate([(self.weights * self.seen).ravel(), [self.seen], self.map.ravel()])


def step_of(z: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(z * 2) + STEPS // 2, 0, STEPS - 1).astype(np.int64)


class Frozen:
    """Weights and map as learned."""

    def __init__(self, weights: np.ndarray, refine: np.ndarray):
        self.weights = weights.astype(np.float32)
        centre = 1 / (1 + np.exp(-(np.arange(STEPS) - STEPS // 2) / 2.0))
        self.refine = ((refine[:, :, 1] + 4 * centre) / (refine.sum(axis=2) + 4)).astype(np.float32).ravel()

    def log10_bit(self, odds: list, known: list, level: int, bit: np.ndarray) -> np.ndarray:
        gate = gate_of(known[0], known[1], level)
        z = sum(self.weights[gate, k] * odds[k] for k in range(CONTEXTS))
        p = 0.5 / (1 + np.exp(-np.clip(z, -15, 15))) + 0.5 * self.refine[gate * STEPS + step_of(z)]
        return np.log10(np.clip(np.where(bit == 1, p, 1 - p), 1e-7, 1.0))


def held_out(doc_id: Column) -> Column:
    fold = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))
    return F.coalesce(fold == HELD_OUT, F.lit(False))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, n): how often training texts hold each unit; 0 for those of held-out texts only."""
    units: Counter = Counter()
    for batch in batches:
        for out, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            got = units_of(words_of(t.as_py()))
            if out:
                for u in got:
                    units.setdefault(u, 0)
            else:
                units.update(got)
            if len(units) > UNITS:
                yield pa.RecordBatch.from_pydict({"unit": list(units), "n": list(units.values())})
                units.clear()
    if units:
        yield pa.RecordBatch.from_pydict({"unit": list(units), "n": list(units.values())})


def pack(units: list[bytes], counts: np.ndarray) -> bytes:
    return np.array([len(units), *map(len, units), *counts], dtype="<i8").tobytes() + b"".join(units)


def unpack(packed: bytes) -> tuple[list[bytes], np.ndarray]:
    size = int(np.frombuffer(packed, "<i8", 1)[0])
    numbers = np.frombuffer(packed, "<i8", 2 * size, 8)
    ends = np.cumsum(numbers[:size]) + 8 + 16 * size
    return [packed[e - n:e] for e, n in zip(ends.tolist(), numbers[:size].tolist(), strict=True)], numbers[size:]


def planes(numbers: np.ndarray) -> bytes:
    """Rows of counts or gaps, all lowest bytes first: the highest are mostly zero and compress away."""
    data = np.ascontiguousarray(np.moveaxis(numbers.astype("<u8")[..., None].view(np.uint8), -1, 0)).tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unplanes(data: bytes, rows: int) -> np.ndarray:
    flat = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(np.moveaxis(flat.reshape(8, rows, -1), 0, -1)).view("<u8")[..., 0]


ASKED = "block long, bucket int, keys binary, n binary, units binary"


def _ask(bucket_bits: int):
    """Blocks of units: what each holds of its distinct (context, byte) pairs, by bucket, and its units."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, units, counts = TaskContext.get().partitionId() << 32, [], []

        def asked() -> pa.RecordBatch:
            own = np.array(counts, dtype=np.int64)
            d = Decisions(units)
            keys, at = distinct(d.keys())
            n = np.bincount(at.ravel(), np.tile(own[d.unit], CONTEXTS), len(keys)).astype(np.int64)
            bucket = (keys >> np.uint64(64 - bucket_bits)).astype(np.int64) if bucket_bits else np.zeros(len(keys), np.int64)
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends, size = [*cuts[1:].tolist(), len(keys)], len(cuts) + 1
            return pa.RecordBatch.from_arrays([
                pa.array([block] * size, pa.int64()), pa.array([*bucket[cuts], block % (1 << bucket_bits)], pa.int32()),
                pa.array([*[planes(np.diff(keys[a:b], prepend=np.uint64(0))[None]) for a, b in zip(cuts, ends, strict=True)], None], pa.binary()),
                pa.array([*[planes(n[None, a:b]) for a, b in zip(cuts, ends, strict=True)], None], pa.binary()),
                pa.array([*[None] * len(cuts), pack(units, own)], pa.binary())], ["block", "bucket", "keys", "n", "units"])

        for batch in batches:
            for u, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                units.append(u)
                counts.append(n)
                if len(units) == STEP_UNITS:
                    yield asked()
                    block, units, counts = block + 1, [], []
        if units:
            yield asked()
    return run


ANSWERED = "block long, bucket int, five binary, rare binary, units binary"


def outcomes(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted distinct keys: the count of the context and of the outcome of each key at its five
    decisions (a decision's total is the outcome before), which keys have eight more, and their outcomes."""
    def below(keys: np.ndarray, n: np.ndarray, j: int) -> np.ndarray:
        node = keys >> np.uint64(PATH_BITS - j)
        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        return np.repeat(np.add.reduceat(n, starts), np.diff(starts, append=len(keys)))

    rare = np.flatnonzero(keys >> np.uint64(8) & np.uint64(31) == 31)
    five = np.stack([below(keys, n, j) for j in range(6)])
    more = np.stack([below(keys[rare], n[rare], j) for j in range(6, 14)]) if len(rare) else np.zeros((8, 0), np.int64)
    return five, rare, more


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the pairs of a bucket, whose rows come together, and answers each block that asked."""
    bucket, asked = None, []

    def answers() -> Iterator[pa.RecordBatch]:
        all_keys, at = distinct(np.concatenate([k for _, k, _ in asked]))
        n = np.zeros(len(all_keys), dtype=np.int64)
        np.add.at(n, at, np.concatenate([n for _, _, n in asked]))
        five, rare, more = outcomes(all_keys, n)
        where = np.full(len(all_keys), -1)
        where[rare] = np.arange(len(rare))
        stop = 0
        for block, keys, _ in asked:
            start, stop = stop, stop + len(keys)
            part = at[start:stop]
            extra = where[part]
            yield one(block, bucket, planes(five[:, part]), planes(more[:, extra[extra >= 0]]), None)

    def one(block, bucket, five, rare, units) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), *[
            pa.array([x], pa.binary()) for x in (five, rare, units)]], ["block", "bucket", "five", "rare", "units"])

    for batch in batches:
        for block, b, keys, n, units in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if units is not None:
                yield one(block, -1, None, None, units)
                continue
            if b != bucket:
                if asked:
                    yield from answers()
                bucket, asked = b, []
            asked.append((block, np.cumsum(unplanes(keys, 1)[0], dtype=np.uint64), unplanes(n, 1)[0].astype(np.int64)))
    if asked:
        yield from answers()


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block: its units and all answers in the order of its keys."""
    block, units, got = None, None, []

    def one() -> pa.RecordBatch:
        five, rare = (np.concatenate([unplanes(g[i], rows) for g in got], axis=1) for i, rows in ((0, 6), (1, 8)))
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (units, planes(five), planes(rare))],
                                          ["units", "five", "rare"])

    for batch in batches:
        for b, _, five, rare, u in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if b != block:
                if got:
                    yield one()
                block, got = b, []
            if u is not None:
                units = u
            else:
                got.append((five, rare))
    if got:
        yield one()


def decisions_of(units: list[bytes], five: bytes, rare: bytes, less: int = 0) -> Iterator[tuple]:
    """(level, units, bit, log odds by context, confidence of the word so far and of five bytes) of a
    block with its answers; the counts without ``less`` occurrences of the decision itself.

    A key fixes its decision and both counts, so log odds are taken once per key, not per position."""
    d = Decisions(units)
    keys, at = distinct(d.keys())
    five, more = unplanes(five, 6).view(np.int64), unplanes(rare, 8).view(np.int64)
    rare_keys = np.flatnonzero(keys >> np.uint64(8) & np.uint64(31) == 31)
    where = np.zeros(len(keys), dtype=np.int32)
    where[rare_keys] = np.arange(len(rare_keys), dtype=np.int32)
    total, shift = five[0], PATH_BITS
    for j, unit, bit in d.levels():
        if j == 5:
            keys, total, at = keys[rare_keys], total[rare_keys], where[at[:, d.symbol == 31]]
        own = five[j + 1] if j < 5 else more[j - 5]
        shift -= 1
        one = (keys >> np.uint64(shift) & np.uint64(1)).astype(bool)
        odds = log_odds((total - own).astype(np.float32), np.maximum(own - less, 0).astype(np.float32))  # of the outcome the key has
        odds = np.where(one, odds, -odds)
        known = confidence(np.maximum(total - less, 0))
        yield j, unit, bit, [odds[at[k]] for k in range(CONTEXTS)], [known[at[k]] for k in (0, 3)]
        total = own


def _teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's weights and map: every block teaches, its decisions predicted without themselves."""
    mixer = Mixer()
    for batch in batches:
        for packed, five, rare in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            units, n = unpack(packed)
            for j, unit, bit, odds, known in decisions_of(units, five, rare, less=1):
                times = n[unit]
                use = np.flatnonzero(times)
                if 0 < len(use) < len(times):
                    odds, known, bit, times = [o[use] for o in odds], [x[use] for x in known], bit[use], times[use]
                if len(use):
                    mixer.teach(odds, known, j, bit, times)
            mixer.seen += float(n.sum())
    if mixer.seen:
        yield pa.RecordBatch.from_pydict({"numbers": [mixer.numbers().tolist()]})


def _log10(model):
    """(unit, n, score) of every unit of the blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for packed, five, rare in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                units, n = unpack(packed)
                out = np.zeros(len(units))
                for j, unit, bit, odds, known in decisions_of(units, five, rare):
                    out += np.bincount(unit, m.log10_bit(odds, known, j, bit), len(units))
                yield pa.RecordBatch.from_arrays([pa.array(units, pa.binary()), pa.array(n), pa.array(out)], ["unit", "n", "score"])
    return run


def taught(blocks: DataFrame) -> Frozen:
    """The model all tasks' blocks teach: one job; a task sends one row of fixed size, and the sums are
    of decimals, the same whatever order they come in."""
    sums = (blocks.mapInArrow(_teach, "numbers array<double>").select(F.posexplode("numbers").alias("at", "x"))
            .groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,9)")).cast("double").alias("x")))
    cut = GATES * CONTEXTS
    total = np.zeros(cut + 1 + GATES * STEPS * 2)
    for r in sums.collect():  # as many rows as the model has numbers
        total[r["at"]] = r["x"]
    weights = total[:cut].reshape(GATES, CONTEXTS) / total[cut] if total[cut] else start_weights()
    return Frozen(weights, total[cut + 1:].reshape(GATES, STEPS, 2))


def score_units(units: DataFrame, bits: int = BITS) -> DataFrame:
    """unit, n and score (log10 probability) of ``units`` (distinct unit, n: its training count)."""
    spark = units.sparkSession
    positions = units.agg(F.sum(F.length("unit") - 3)).first()[0] or 0
    bucket_bits = max(0, (positions * CONTEXTS >> bits).bit_length())
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    word = F.substring("unit", 5, 1 << 30)
    asked = (units.repartition(partitions, F.substring("unit", 5, 3), F.pmod(F.crc32(word), F.lit(4)))  # the same blocks in every run
             .sortWithinPartitions(word, "unit").mapInArrow(_ask(bucket_bits), ASKED))
    answered = (asked.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(_answer, ANSWERED))
    blocks = materialize(answered.repartition(partitions, "block").sortWithinPartitions("block", "bucket")
                         .mapInArrow(_gather, "units binary, five binary, rare binary"), "lm-blocks")
    model = spark.sparkContext.broadcast(taught(blocks))
    return blocks.mapInArrow(_log10(model), "unit binary, n long, score double")


def _score(common):
    """Per document: n_tokens, the common units' share of the scores, and its other units."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, score, base, seen = common.value
        for batch in batches:
            rows = [words_of(t.as_py()) for t in batch.column(2)]
            at = 0
            while at < len(rows):  # groups of documents, so that units of a batch of long texts stay bounded
                stop, units, sizes = at, [], []
                while stop < len(rows) and len(units) < GROUP_WORDS:
                    own = units_of(rows[stop])
                    units += own
                    sizes.append(len(own))
                    stop += 1
                doc = np.repeat(np.arange(len(sizes)), sizes)
                i = np.fromiter(map(place.get, units, repeat(-1)), dtype=np.int64, count=len(units))
                missing = list(compress(units, (i < 0).tolist()))
                ends = np.cumsum(np.bincount(doc[i < 0], minlength=len(sizes))).tolist()
                others = [Counter(missing[a:b]) for a, b in pairwise([0, *ends])]
                doc, i = doc[i >= 0], i[i >= 0]
                found, based, scored = (np.bincount(doc, x[i], len(sizes)) for x in (seen, base, score))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[at:stop], batch.column(1)[at:stop], pa.array(sizes, pa.int64()),
                    pa.array(scored, pa.float64()), pa.array(found.astype(np.int64)), pa.array(based, pa.float64()),
                    pa.array([list(o) for o in others], pa.list_(pa.binary())),
                    pa.array([list(o.values()) for o in others], pa.list_(pa.int64()))],
                    ["doc_id", "held_out", "n_tokens", "common_score", "found", "base", "others", "times"])
                at = stop
    return run


def commonest(scored: DataFrame, most: int) -> DataFrame:
    """The rows of ``scored`` (a written table) that reach the least count which at most ``most`` units
    of at most ``COMMON_BYTES`` bytes reach: an aggregate of a few thousand levels finds it, no sort."""
    short = scored.where(F.length("unit") <= COMMON_BYTES + 4)
    exact = 4096  # counts below are levels of their own, larger ones share sixteen per doubling
    level = F.when(F.col("n") < exact, F.col("n")).otherwise(exact + F.floor(F.log2(F.col("n") / exact) * 16))
    levels = short.groupBy(level.cast("long").alias("level")).agg(F.count(F.lit(1)).alias("units")).collect()
    least, units = 1 << 62, 0
    for r in sorted(levels, key=lambda r: -r["level"]):
        units += r["units"]
        if units > most:
            break
        least = r["level"]
    return short.where(level >= least)


def lm_scores(docs: DataFrame, bits: int = BITS, common_words: int = COMMON_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every
    row of ``docs`` (doc_id, text and any other columns).

    The score is the model's log10 probability of the text as the lower-cased words, a space after each,
    and the end.  Null text is empty: the end alone.  Rows with a null doc_id train.  Rows that repeat
    train and score each; without training rows the model is uniform over each decision; an empty table
    gives no rows.
    """
    sc = docs.sparkSession.sparkContext
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    units = materialize(rows.select("held_out", "text").mapInArrow(_units, "unit binary, n long")
                        .groupBy("unit").agg(F.sum("n").alias("n")), "lm-units")
    words = (units.groupBy(F.substring("unit", 5, 1 << 30).alias("word")).agg(F.sum("n").alias("word_n")))
    totals = words.where("word_n > 0").agg(F.sum("word_n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = totals["n"] or 0, totals["v"]
    scored = materialize(score_units(units, bits).withColumn("w", F.substring("unit", 5, 1 << 30))
                         .join(words, F.col("w") == F.col("word")).select("unit", "n", "score", "word_n"), "lm-scored")
    top = commonest(scored, common_words).select("unit", "score", "word_n").toPandas()  # at most common_words rows
    times = top["word_n"].to_numpy(float)
    common = ({bytes(u): i for i, u in enumerate(top["unit"])}, top["score"].to_numpy(float), np.log10(times + 1.0),
              (times > 0).astype(float))
    found = materialize(
        rows.mapInArrow(_score(sc.broadcast(common)),
                        "doc_id long, held_out boolean, n_tokens long, common_score double, found long, base double, "
                        "others array<binary>, times array<long>")
        .withColumn("rid", F.monotonically_increasing_id()), "lm-found")
    pairs = found.select("rid", F.explode(F.arrays_zip("others", "times")).alias("o")).select(
        "rid", F.col("o.others").alias("other"), F.col("o.times").alias("t"))
    rare = (pairs.join(scored, F.col("other") == F.col("unit"))
            .groupBy(F.col("rid").alias("r0")).agg(
                F.sum(F.when(F.col("word_n") > 0, F.col("t")).otherwise(F.lit(0))).alias("rare_found"),
                F.sum(F.col("t") * F.log10(F.col("word_n") + F.lit(1.0))).alias("rare_base"),
                F.sum(F.col("t") * F.col("score")).alias("rare_score")))
    known = F.col("found") + F.coalesce("rare_found", F.lit(0))
    base = F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))
    return (found.join(rare, F.col("rid") == F.col("r0"), "left")
            .select("doc_id", "held_out", "n_tokens", known.cast("long").alias("n_known"),
                    F.lit(int(n)).cast("long").alias("train_tokens"), base.alias("base_score"),
                    (F.col("common_score") + F.coalesce("rare_score", F.lit(0.0))).alias("score")))
