"""Exact deduplication by a Golomb-coded fingerprint exchange.

1. Every partition of the documents (a *sender*) hashes its normalised texts, sorts and deduplicates
   the fingerprints and sends each *owner* of a hash range the gaps between them, Golomb (Rice) coded.
   A text that a sender holds many times costs one code word, so a hot group is no hot key.
2. An owner decodes the lists of its range and answers each sender with a bitmap: which of its
   fingerprints occur elsewhere too.
3. The answer meets the sender's own documents through a narrow ``zip`` (no text moves).  Documents
   whose fingerprint repeats, here or elsewhere, are *suspects*; only their texts are shuffled, and
   grouped by the text itself, which is the byte-for-byte check.  All others are unique.

RDDs serve for the one thing DataFrames lack: giving each partition an answer addressed to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routelens.llm.common import bounded_batches, small_side
from routelens.session import materialize

FINGERPRINT_BITS = 48


def normalise(text: str | None) -> bytes:
    """UTF-8 of ``text`` with each run of white space (space, controls 9 to 13) made one space."""
    if not text:
        return b""
    raw = text.encode()
    words = raw.split()  # of bytes: exactly these white-space characters
    if not words:
        return b" "
    return (b" " if raw[:1].isspace() else b"") + b" ".join(words) + (b" " if raw[-1:].isspace() else b"")


def rice_encode(values: np.ndarray, universe: int) -> bytes:
    """Sorted distinct ``values`` below ``universe`` as gap codes: header (count, k, bits), the unary
    quotients, then k-bit remainders."""
    n = len(values)
    if not n:
        return b""
    gaps = np.diff(values.astype(np.int64), prepend=-1) - 1
    k = max(0, int(np.log2(max(universe / n, 1.0))))
    quotient = gaps >> k
    unary = np.zeros(int(quotient.sum()) + n, dtype=np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 1
    rest = ((gaps[:, None] >> np.arange(k - 1, -1, -1)) & 1).astype(np.uint8).ravel()
    head = np.array([n, k, len(unary)], dtype="<i8").tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(rest).tobytes()


def rice_decode(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, dtype=np.int64)
    n, k, bits = np.frombuffer(blob, "<i8", 3).tolist()
    at = 24 + (bits + 7) // 8
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, offset=24, count=at - 24), count=bits))
    quotient = np.diff(ones, prepend=-1) - 1
    rest = np.unpackbits(np.frombuffer(blob, np.uint8, offset=at), count=n * k).reshape(n, k).astype(np.int64)
    gaps = (quotient << k) + rest @ (1 << np.arange(k - 1, -1, -1, dtype=np.int64))
    return np.cumsum(gaps + 1) - 1


def _fingerprint(norm: bytes, bits: int) -> int:
    import xxhash
    return xxhash.xxh3_64_intdigest(norm) >> (64 - bits)


LISTS = "sender int, owner int, n_rows long, total long, codes binary, here binary"


def _send(owners: int, bits: int, text_at: int):
    """Pass 1 over one sender: per owner the list and which of it repeats here; the first list also
    carries the sender's row count and fingerprint total, by which pass 2 knows it sees the same rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        sender = TaskContext.get().partitionId()
        prints = np.array([_fingerprint(normalise(t.as_py()), bits) for b in batches for t in b.column(text_at)],
                          dtype=np.int64)
        values, counts = np.unique(prints, return_counts=True)
        width = -(-(1 << bits) // owners)
        cuts = np.searchsorted(values, np.arange(owners + 1, dtype=np.int64) * width)
        n_rows, total = len(prints), int(prints.sum() % (1 << bits))
        for owner in range(owners):
            a, b = int(cuts[owner]), int(cuts[owner + 1])
            if a < b:
                yield pa.RecordBatch.from_arrays([
                    pa.array([sender], pa.int32()), pa.array([owner], pa.int32()), pa.array([n_rows], pa.int64()),
                    pa.array([total], pa.int64()), pa.array([rice_encode(values[a:b] - owner * width, width)]),
                    pa.array([np.packbits(counts[a:b] > 1).tobytes()])],
                    ["sender", "owner", "n_rows", "total", "codes", "here"])
                n_rows = total = 0
    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owners' side.  Rows of an owner come together, in any order; a task holds one owner's lists."""
    def reply(owner_rows: list[dict]) -> pa.RecordBatch:
        lists = [rice_decode(r["codes"]) for r in owner_rows]
        everything = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        values, counts = np.unique(everything, return_counts=True)
        repeated = values[counts > 1]
        bitmaps = []
        for r, x in zip(owner_rows, lists, strict=True):
            here = np.unpackbits(np.frombuffer(r["here"], np.uint8), count=len(x)).astype(bool)
            bitmaps.append(np.packbits(here | np.isin(x, repeated, assume_unique=True)).tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array([r["sender"] for r in owner_rows], pa.int32()),
             pa.array([r["owner"] for r in owner_rows], pa.int32()),
             pa.array([r["n_rows"] for r in owner_rows], pa.int64()),
             pa.array([r["total"] for r in owner_rows], pa.int64()),
             pa.array([r["codes"] for r in owner_rows], pa.binary()), pa.array(bitmaps, pa.binary())],
            ["sender", "owner", "n_rows", "total", "codes", "bitmap"])

    held: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if held and held[-1]["owner"] != r["owner"]:
                yield reply(held)
                held = []
            held.append(r)
    if held:
        yield reply(held)


def _deliver(bits: int, owners: int):
    """One element per document of the sender: the first carries its repeated fingerprints."""
    def run(rows: Iterator) -> Iterator:
        width = -(-(1 << bits) // owners)
        n, total, found = 0, 0, []
        for _, (owner, n_rows, part, codes, bitmap) in rows:
            n, total = n + n_rows, total + part
            x = rice_decode(codes)
            mask = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(x)).astype(bool)
            found.append(x[mask] + owner * width)
        if n:
            yield total, np.concatenate(found).tobytes()
            for _ in range(n - 1):
                yield None
    return run


def _judge(bits: int, text_at: int, carry: list[int]):
    """Pass 2 over one sender: digest of every document, the normalised text of suspects only."""
    def run(sender: int, rows: Iterator) -> Iterator[tuple]:
        repeated: set[int] = set()
        expected = seen = 0
        for at, (row, answer) in enumerate(rows):
            if answer is not None:
                expected, repeated = answer[0], set(np.frombuffer(answer[1], np.int64).tolist())
            norm = normalise(row[text_at])
            print_ = _fingerprint(norm, bits)
            seen += print_
            yield (*[row[i] for i in carry], (sender << 40) + at, hashlib.sha256(norm).hexdigest(),
                   norm.decode() if print_ in repeated else None)
        if (seen - expected) % (1 << bits):
            raise RuntimeError("a partition of the documents changed between two passes: write them to a table first")
    return run


def exact_groups(docs: DataFrame, carry: list[str] | None = None, owners: int | None = None,
                 bits: int = FINGERPRINT_BITS) -> DataFrame:
    """``__row`` (the ``carry`` columns of ``docs``, all by default, as a struct), keep_id, group_size,
    kept and text_sha256 for every row of ``docs`` (doc_id, text and any other columns).

    Texts are equal when identical after white-space normalisation; null counts as empty.  Of equal
    texts the row with the smallest doc_id stays (null ids last; of rows that repeat an id, one).
    An empty table gives no rows.  Both passes read ``docs``: it must be partitioned alike each time,
    as a file scan is; if a partition's rows differ between the passes, the job fails.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    carry = docs.columns if carry is None else carry
    fields = list(dict.fromkeys([*carry, "doc_id", "text"]))
    source = bounded_batches(docs).select(*[F.col(f"`{c}`") for c in fields])
    rows = source.rdd
    owners = owners or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text_at = fields.index("text")

    sent = source.mapInArrow(_send(owners, bits, text_at), LISTS)
    answers = materialize(
        sent.repartition(owners, "owner").sortWithinPartitions("owner")
        .mapInArrow(_answer, LISTS.replace("here", "bitmap")), "dedup-answers")

    senders = rows.getNumPartitions()
    to_sender = (answers.rdd.map(lambda r: (r["sender"], (
                     r["owner"], r["n_rows"], r["total"], bytes(r["codes"]), bytes(r["bitmap"]))))
                 .partitionBy(senders, lambda sender: sender))
    padding = to_sender.getNumPartitions() - senders
    if padding > 0:
        rows = rows.union(sc.parallelize([], padding))
    zipped = rows.zip(to_sender.mapPartitions(_deliver(bits, owners)))

    schema = T.StructType([T.StructField(f"c{i}", source.schema[c].dataType) for i, c in enumerate(fields)]
                          + [T.StructField("rid", T.LongType()), T.StructField("text_sha256", T.StringType()),
                             T.StructField("norm", T.StringType())])
    wanted = [fields.index(c) for c in dict.fromkeys([*carry, "doc_id"])]
    judged = spark.createDataFrame(
        zipped.mapPartitionsWithIndex(_judge(bits, text_at, wanted)),
        T.StructType([schema[i] for i in wanted] + list(schema)[-3:]), verifySchema=False)
    judged = materialize(judged.select(
        F.struct(*[F.col(f"c{fields.index(c)}").alias(c) for c in carry]).alias("__row"),
        F.col(f"c{fields.index('doc_id')}").alias("id"), "rid", "text_sha256", "norm"), "dedup-judged")

    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "rid"))
    suspects = judged.where(F.col("norm").isNotNull())
    groups = suspects.groupBy("text_sha256", "norm").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
    # one text per digest, or the job fails: a SHA-256 collision must not merge two texts
    groups = (groups.groupBy(F.col("text_sha256").alias("sha0"))
              .agg(F.min("first").alias("first"), F.max("group_size").alias("group_size"),
                   F.count(F.lit(1)).alias("texts"))
              .where(F.coalesce(F.assert_true(F.col("texts") == 1, F.lit("two texts share a SHA-256")).isNull(),
                                F.lit(True))))
    groups = small_side(materialize(groups, "dedup-groups"), 150)
    same = suspects.join(groups, F.col("text_sha256") == F.col("sha0")).select(
        "__row", F.col("first.id").alias("keep_id"), "group_size",
        (F.col("rid") == F.col("first.rid")).alias("kept"), "text_sha256")
    alone = judged.where(F.col("norm").isNull()).select(
        "__row", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    return alone.unionByName(same)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns."""
    return exact_groups(docs).where("kept").select("__row.*")


def dedup_digest(docs: DataFrame) -> DataFrame:
    return exact_groups(docs, carry=["doc_id"]).select("__row.doc_id", "keep_id", "group_size", "kept", "text_sha256")
