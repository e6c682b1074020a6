"""SimHash near-duplicates by generalised pigeonhole.

If the 64 bits are dealt into groups and group g is given a threshold t_g (-1: the group is not used)
with the sum of t_g + 1 equal to d + 1, any two fingerprints within d bits agree to within t_g bits in
some group g.  Correlated bits share a group, so that skew gathers in few of them, and a dynamic
programme hands out the thresholds at the least estimated cost of probes and candidates; both use a
bounded sample and decide only the cost, never the result.

Fingerprints that agree in a group meet in a bucket and are verified by their full distance.  A bucket
of over ``BUCKET`` rows (near copies share most bits) is refined by the same principle: its free bits
are dealt into d + 1 blocks, of which one must agree; this repeats until buckets are small, at the
latest when so few bits are free that a bucket can't be large.  Buckets emit a spanning forest of
their links, never all pairs, and components are joined up in Spark.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelens.llm.common import as_row, bounded_batches, small_side
from routelens.llm.components import star_components
from routelens.session import materialize

BITS = 64
SEED = 42
SAMPLE = 4096
BUCKET = 256
#: A probe is a shuffled row, a candidate one comparison of two words in a task.
PROBE_COST = 100.0


def simhash(text: str | None, words: int = 3) -> int:
    """The fingerprint of a whole text, unsigned."""
    import xxhash
    found = text.encode().lower().split() if text else []  # of bytes: A-Z only, the contract's white space
    if not found:
        return 0
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        hashes = [digest(joined, SEED)]
    else:
        hashes = [digest(joined[a:b], SEED) for a, b in
                  zip(starts[:-words + 1 or None].tolist(), ends[words - 1:].tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, tag (the whole text's XXH64, seed 42) and fp (the 64 bits as a signed long) of every row;
    null and wordless texts have fp 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((simhash(t.as_py(), words) for t in batch.column(1)), dtype=np.uint64,
                                 count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints.view(np.int64))],
                                             ["doc_id", "tag", "fp"])

    return (bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tag"))
            .mapInArrow(run, "doc_id long, tag long, fp long"))


def correlated_groups(bits: np.ndarray, groups: int) -> list[list[int]]:
    """The bit numbers dealt into ``groups`` groups of nearly equal width; each starts with the most
    correlated pair left and grows by the bit most correlated with it."""
    centred = bits - bits.mean(axis=0)
    spread = np.sqrt((centred ** 2).sum(axis=0))
    corr = np.abs(centred.T @ centred) / np.maximum(np.outer(spread, spread), 1e-9)
    corr[spread == 0, :] = corr[:, spread == 0] = 1.0  # constant bits tell nothing apart: keep them together
    np.fill_diagonal(corr, 0.0)
    left, out = list(range(BITS)), []
    for g in range(groups):
        width = len(left) // (groups - g)
        sub = corr[np.ix_(left, left)]
        i, j = np.unravel_index(int(sub.argmax()), sub.shape)
        group = [left[i], left[j]] if i != j else [left[0], left[1]]
        left = [b for b in left if b not in group]
        while len(group) < width:
            best = max(left, key=lambda b: corr[b, group].sum())
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def mask_of(bits: list[int]) -> int:
    """The mask of the bit numbers as a signed 64-bit value."""
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def plan(sample: np.ndarray, total: int, distance: int) -> list[tuple[list[int], int]]:
    """Groups in use and their thresholds: [(bit numbers, threshold)], the cheapest for ``total``
    distinct fingerprints (1,000 at least) by what the sample (unsigned 64-bit) shows."""
    total = max(total, 1000)
    if len(sample) < 2:
        sample = np.array([0, 1], dtype=np.uint64)
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    some = sample[:2048]
    a, b = np.triu_indices(len(some), 1)
    apart = some[a] ^ some[b]
    best: tuple[float, list] | None = None
    for m in range(max(1, distance), distance + 3):
        groups = correlated_groups(bits, m)
        costs = []
        for g in groups:
            near = np.bincount(np.bitwise_count(apart & np.uint64(mask_of(g) & (1 << 64) - 1)).astype(np.int64),
                               minlength=BITS + 1).cumsum() / len(apart)
            row = [0.0]
            for t in range(distance + 1):
                probes = sum(comb(len(g), i) for i in range(t + 1))
                chance = max(near[t], probes / 2.0 ** len(g))
                row.append(total * (probes + (t > 0)) * PROBE_COST + total * total / 2 * chance)
            costs.append(row)
        # state: units of threshold + 1 handed out so far
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for row in costs:
            grown: dict[int, tuple[float, list[int]]] = {}
            for units, (cost, chosen) in table.items():
                for u in range(min(len(row) - 1, distance + 1 - units) + 1):
                    c = cost + row[u]
                    if units + u not in grown or c < grown[units + u][0]:
                        grown[units + u] = (c, [*chosen, u])
            table = grown
        if distance + 1 in table and (best is None or table[distance + 1][0] < best[0]):
            cost, chosen = table[distance + 1]
            best = (cost, [(g, u - 1) for g, u in zip(groups, chosen, strict=True) if u])
    return best[1]


def _bucket_rows(classes: DataFrame, used: list[tuple[list[int], int]]) -> DataFrame:
    """(path, key, role, fp): role 0 compares with its like, 1 (index) with 2 (probes)."""
    def entry(path: int, role: int, value: Column) -> Column:
        return F.struct(F.lit(path).alias("path"), F.xxhash64(F.lit(path), value).alias("key"),
                        F.lit(role).cast("byte").alias("role"))

    def probes(path: int, here: Column, bits: list[int], threshold: int) -> Column:
        flips = F.array(*[F.lit(mask_of(list(flip))).cast("long") for n in range(threshold + 1)
                          for flip in itertools.combinations(bits, n)])
        return F.transform(flips, lambda flip: entry(path, 2, here.bitwiseXOR(flip)))

    own, probed = [], []
    for path, (bits, threshold) in enumerate(used):
        here = F.col("fp").bitwiseAND(F.lit(mask_of(bits)).cast("long"))
        own.append(entry(path, int(threshold > 0), here))
        if threshold:
            probed.append(probes(path, here, bits, threshold))
    entries = F.concat(F.array(*own), *probed) if probed else F.array(*own)
    return classes.select("fp", F.explode(entries).alias("e")).select("e.path", "e.key", "e.role", "fp")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links: every node but the smallest of its component, and that one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    low = np.arange(len(nodes))
    while True:
        was = low.copy()
        m = np.minimum(low[x], low[y])
        np.minimum.at(low, low[x], m)
        np.minimum.at(low, low[y], m)
        low = low[low]
        if (low == was).all():
            break
    inner = low != np.arange(len(nodes))
    return nodes[inner], nodes[low[inner]]


def _links(distance: int):
    """Verifies the rows of a partition, sorted by key, bucket by bucket across batch borders."""
    def check(key: np.ndarray, role: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        at, a, b = np.arange(len(key)), [], []
        for shift in range(1, len(key)):
            at = at[at + shift < len(key)]
            at = at[key[at] == key[at + shift]]
            if not len(at):
                break
            to = at + shift
            near = np.bitwise_count(fp[at] ^ fp[to]) <= distance
            near &= (role[at] == 0) | (role[at] != role[to])
            near &= fp[at] != fp[to]
            a.append(fp[at[near]])
            b.append(fp[to[near]])
            if sum(map(len, a)) > 1_000_000:
                x, y = _forest(np.concatenate(a), np.concatenate(b))
                a, b = [x], [y]
        if not a or not sum(map(len, a)):
            return None
        x, y = _forest(np.concatenate(a), np.concatenate(b))
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, role, fp = np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.uint64)
        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy()])
            role = np.concatenate([role, batch.column(1).to_numpy()])
            fp = np.concatenate([fp, batch.column(2).to_numpy().view(np.uint64)])
            end = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last bucket may go on
            if end:
                if (found := check(key[:end], role[:end], fp[:end])) is not None:
                    yield found
                key, role, fp = key[end:], role[end:], fp[end:]
        if len(key) and (found := check(key, role, fp)) is not None:
            yield found

    return run


def _verified(rows: DataFrame, distance: int) -> DataFrame:
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.select("key", "role", "fp").repartition(partitions, "key").sortWithinPartitions("key")
            .mapInArrow(_links(distance), "a long, b long"))


def links(classes: DataFrame, distance: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between the fingerprints of ``classes`` (fp, distinct, a written table) that join
    up exactly what links of at most ``distance`` bits join up."""
    total = classes.count()
    share = min(1.0, SAMPLE / max(total, 1))
    sampled = classes.where(F.pmod(F.xxhash64(F.lit(7), "fp"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    got = np.array([r["fp"] for r in sampled.collect()], dtype=np.int64)  # about SAMPLE rows
    used = plan(np.sort(got).view(np.uint64)[:2 * SAMPLE], total, distance)
    free = {path: [b for b in range(BITS) if b not in bits] for path, (bits, _) in enumerate(used)}
    rows, found = _bucket_rows(classes, used), []
    while True:
        counts = rows.groupBy("path", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket)
        hot = materialize(counts.select(F.col("path").alias("p0"), F.col("key").alias("k0")), "simhash-hot")
        # a bucket whose free bits can't tell many more than ``bucket`` fingerprints apart stays as it is
        paths = [r["p0"] for r in hot.select("p0").distinct().collect()
                 if len(free[r["p0"]]) > 2 * distance + 1 and 2 ** len(free[r["p0"]]) > bucket]
        hot = hot.where(F.col("p0").isin(paths))
        if not paths:
            found.append(_verified(rows, distance))
            break
        side = small_side(hot.select("k0"), 16)
        found.append(_verified(rows.join(side, F.col("key") == F.col("k0"), "left_anti"), distance))
        inside = rows.join(side, F.col("key") == F.col("k0"), "left_semi")
        blocks, deeper = {}, {}
        for path in paths:
            blocks[path] = np.array_split(np.array(free[path]), distance + 1)
            for j, block in enumerate(blocks[path]):
                deeper[path * 8 + j + 64] = [b for b in free[path] if b not in block.tolist()]
        masks = F.create_map(*[x for path in paths for x in (
            F.lit(path), F.array(*[F.lit(mask_of(b.tolist())).cast("long") for b in blocks[path]]))])
        entries = inside.select("path", "key", "role", "fp", F.posexplode(masks[F.col("path")]).alias("j", "m"))
        rows = materialize(entries.select(
            (F.col("path") * 8 + F.col("j") + 64).alias("path"),
            F.xxhash64("key", "j", F.col("fp").bitwiseAND(F.col("m"))).alias("key"), "role", "fp"), "simhash-refined")
        free = deeper
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def grouped(docs: DataFrame, words: int, distance: int, bucket: int) -> DataFrame:
    """doc_id, tag, fp, root (a fingerprint that names the component) and component_id of every row."""
    prints = materialize(fingerprints(docs, words), "simhash-prints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    joined = materialize(star_components(links(classes.select("fp"), distance, bucket)), "simhash-joined")
    linked = classes.join(small_side(joined, 40), F.col("fp") == F.col("node"), "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    lowest = materialize(linked.groupBy(F.col("root").alias("r0")).agg(F.min("first_id").alias("component_id")),
                         "simhash-lowest")
    of_class = materialize(linked.join(small_side(lowest, 40), F.col("root") == F.col("r0"))
                           .select(F.col("fp").alias("f0"), "root", "component_id"), "simhash-components")
    return (prints.join(small_side(of_class, 48), F.col("fp") == F.col("f0"))
            .select("doc_id", "tag", "fp", "root", "component_id"))


def near_groups(docs: DataFrame, words: int = 3, distance: int = 3, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp (signed long) and component_id (the smallest doc_id reachable over fingerprints that
    differ in at most ``distance`` bits) of every row of ``docs`` (doc_id, text, any other columns).

    Null and wordless texts have fingerprint 0 and link like any other; texts of any length are read
    whole; rows that repeat a doc_id each get a row; null doc_ids are never a component_id unless a
    component has no other; an empty table gives no rows.
    """
    return grouped(docs, words, distance, bucket).select("doc_id", "fp", "component_id")


def one_per_group(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """One row of each component of ``docs``, with the columns of ``docs``: that with the smallest doc_id
    (null last), of several the one whose text has the smallest XXH64, of rows equal in both the one whose
    JSON form is smallest.  Rows are told apart by doc_id and text, so a repeated doc_id loses only those
    of its rows that are near copies of a row that stays; an empty table gives no rows."""
    rows = materialize(grouped(docs, words, distance, BUCKET).select("doc_id", "tag", "root", "component_id"), "simhash-grouped")
    lowest = F.col("doc_id").eqNullSafe(F.col("component_id"))
    # components with several rows of their smallest doc_id; none where doc_ids are unique
    several = materialize(rows.where(lowest).groupBy(F.col("root").alias("r0"))
                          .agg(F.min("tag").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-several")
    rivals = materialize(rows.where(lowest).join(small_side(several, 32), F.col("root") == F.col("r0"))
                         .select("doc_id", "tag", "keep"), "simhash-rivals")
    gone = rows.where(~lowest).select("doc_id", "tag").unionByName(rivals.where("tag <> keep").select("doc_id", "tag"))

    def known(ids: DataFrame, name: str) -> DataFrame:
        ids = ids.select(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag"))
        return small_side(materialize(ids, name), 32)

    on = F.col("__row.doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("__row.text") == F.col("__tag"))
    left = as_row(docs).join(known(gone.distinct(), "simhash-gone"), on, "left_anti")
    if rivals.isEmpty():
        return left.select("__row.*")
    again = known(rivals.where("tag = keep").groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
                  "simhash-repeats")
    least = (left.join(again, on).groupBy("__id", "__tag")
             .agg(F.min_by("__row", F.to_json("__row")).alias("__row")).select("__row.*"))
    return left.join(again, on, "left_anti").select("__row.*").unionAll(least)


def simhash_digest(docs: DataFrame, **params) -> DataFrame:
    return near_groups(docs, **params).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
