"""Line deduplication by range-partitioned line hashes and keep bitmaps.

1. One pass over the texts writes a row per document and distinct line key: a 128-bit hash, the
   document, and the line's position.  Texts stay where they are.
2. These rows are range-partitioned by (hash, document, position) and sorted likewise, so a line that
   half of all documents share spans many tasks.  A task streams its rows: the first document of a hash
   keeps its lines, all others lose theirs.  The first hash of a task may have begun in an earlier one;
   the few rows this leaves open are settled by the two edge rows that every task reports.
3. What goes back to the documents is a compressed bitmap per document (the parts of different tasks
   are or-ed), addressed to the partition that holds the text and met there by a narrow ``zip``: no text
   is shuffled.

RDDs serve for that last step alone: DataFrames cannot address a partition.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routelens.llm.common import batch_rows
from routelens.session import materialize

#: Code points a key must have for its line to count as repeated.
LEAST = 10
#: Dropped lines that a task holds before it sends their bitmaps.
HELD = 1_000_000
SPACE = b" \t\n\x0b\x0c\r"
#: A row id is the partition number and, below it, the place in the partition.
PLACE_BITS = 40


def line_key(line: bytes, least: int = LEAST) -> bytes | None:
    """The line stripped of white space and with A-Z lower-cased; None if shorter than ``least`` code points."""
    key = line.strip(SPACE)
    if len(key) < least or (len(key) < 4 * least and len(key.decode()) < least):
        return None
    return key.lower()  # of bytes: A-Z only


def to_bits(positions: np.ndarray) -> bytes:
    """Sorted positions as a bitmap: its first byte's number, then its bytes, deflated if that is shorter."""
    start = int(positions[0]) >> 3
    mask = np.zeros(((int(positions[-1]) >> 3) - start + 1) * 8, dtype=np.uint8)
    mask[positions - 8 * start] = 1
    raw = np.packbits(mask).tobytes()
    small = zlib.compress(raw, 1) if len(raw) > 16 else raw
    body = b"\1" + small if len(small) < len(raw) else b"\0" + raw
    return start.to_bytes(4, "little") + body


def from_bits(bits: bytes) -> np.ndarray:
    raw = zlib.decompress(bits[5:]) if bits[4] else bits[5:]
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8))) + 8 * int.from_bytes(bits[:4], "little")


def _keys(least: int):
    """Pass 1 over (no_id, doc, text): a row per document and distinct key, at the key's first line; at
    the end of a partition one row (pos -1) with its row count and a checksum of its texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext
        sender = TaskContext.get().partitionId() << PLACE_BITS
        seen, total, kind = 0, 0, None

        def out(h, no_id, doc, rid, pos, n_rows, total):
            n = len(pos)
            return pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0]), pa.array(h[:, 1]), no_id, doc, pa.array(rid, pa.int64()), pa.array(pos, pa.int32()),
                 pa.array([n_rows] * n, pa.int64()), pa.array([total] * n, pa.int64())],
                ["h1", "h2", "no_id", "doc", "rid", "pos", "n_rows", "total"])

        for b in batches:
            row, pos, digests, kind = [], [], [], b.schema.field(1).type
            for i, raw in enumerate(b.column(2).cast(pa.binary()).to_pylist()):
                raw = raw or b""
                total += zlib.crc32(raw)
                keys: dict[bytes, int] = {}
                for p, line in enumerate(raw.split(b"\n")):
                    key = line_key(line, least)
                    if key is not None and key not in keys:
                        keys[key] = p
                digests += [xxhash.xxh3_128_digest(k) for k in keys]
                pos += keys.values()
                row += [i] * len(keys)
            if pos:
                at = np.array(row, dtype=np.int64)
                h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
                yield out(h, b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), sender + seen + at, pos, None, None)
            seen += b.num_rows
        if seen:
            yield out(np.zeros((1, 2), dtype=np.int64), pa.array([False]), pa.nulls(1, kind), [sender], [-1], seen, total)
    return run


DROPPED, OPEN, EDGE = 0, 1, 2


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (hash, document, row): DROPPED rows (a bitmap per document row), OPEN rows of
    the first hash's first document, and EDGE rows: the first and the last hash with the first document
    that this task saw of each."""
    lead = last = kind = None
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def row(what: int, key: tuple, rid=None, bits=None) -> dict:
        return {"kind": what, "h1": int(key[0]), "h2": int(key[1]), "no_id": bool(key[2]), "doc": key[3], "rid": rid, "bits": bits}

    def batch(rows: list[dict]) -> pa.RecordBatch:
        types = [("kind", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("no_id", pa.bool_()), ("doc", kind),
                 ("rid", pa.int64()), ("bits", pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in types], [c for c, _ in types])

    def send() -> Iterator[pa.RecordBatch]:
        if held:
            rid, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((pos, rid))
            rid, pos = rid[order], pos[order]
            cuts = np.flatnonzero(np.diff(rid)) + 1
            bits = [to_bits(p) for p in np.split(pos, cuts)]
            n, rids = len(bits), rid[np.concatenate([[0], cuts])]
            empty = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, DROPPED, np.int32)), empty, empty, pa.nulls(n, pa.bool_()), pa.nulls(n, kind),
                 pa.array(rids), pa.array(bits, pa.binary())], ["kind", "h1", "h2", "no_id", "doc", "rid", "bits"])

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        kind = b.schema.field(3).type
        h1, h2, no_id, doc, rid, pos = (b.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        new = np.ones(n, dtype=bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        if last is not None:
            new[0] = (h1[0], h2[0]) != last[:2]
        start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        first_no, first_doc = no_id[np.maximum(start, 0)], doc[np.maximum(start, 0)]
        if last is not None:
            first_no[start < 0], first_doc[start < 0] = last[2:]
        lead = lead or (h1[0], h2[0], no_id[0], b.column(3)[0].as_py())
        later = (no_id != first_no) | (doc != first_doc)
        if later.any():
            held.append((rid[later], pos[later]))
        unsure = np.flatnonzero(~later & (h1 == lead[0]) & (h2 == lead[1]))
        if len(unsure):
            yield batch([row(OPEN, lead, int(rid[i]), to_bits(pos[i:i + 1])) for i in unsure.tolist()])
        last = (h1[-1], h2[-1], first_no[-1], first_doc[-1])
        if sum(len(r) for r, _ in held) > HELD:
            yield from send()
    yield from send()
    if lead is not None:
        tail = (*last[:3], last[3].item() if hasattr(last[3], "item") else last[3])
        yield batch([row(EDGE, lead), row(EDGE, tail)])


def _deliver(parts: Iterator) -> Iterator:
    """One element per document of the partition: its bitmaps, if any; the first carries the checksum."""
    n, total, found = 0, 0, {}
    for _, (rid, n_rows, checksum, bits) in parts:
        if bits is None:
            n, total = n + n_rows, total + checksum
        else:
            found.setdefault(rid & ((1 << PLACE_BITS) - 1), []).append(bits)
    for i in range(n):
        yield (None if i else total, found.get(i))


def _apply(text_at: int, carry: list[int], least: int, digest: bool):
    """Pass 2 over one partition: every document's lines less those in its bitmaps."""
    def run(rows: Iterator) -> Iterator[tuple]:
        expected = seen = 0
        for row, (total, parts) in rows:
            expected = total if total is not None else expected
            text = row[text_at]
            raw = (text or "").encode()
            seen += zlib.crc32(raw)
            n_lines, dropped = raw.count(b"\n") + 1, 0
            if parts:
                lines = raw.split(b"\n")
                gone = {line_key(lines[p], least) for bits in parts for p in from_bits(bits).tolist()}
                stay = [x for x in lines if (k := line_key(x, least)) is None or k not in gone]
                dropped, raw = n_lines - len(stay), b"\n".join(stay)
            result = hashlib.sha256(raw).hexdigest() if digest else None if text is None else raw.decode()
            yield (*[row[i] for i in carry], n_lines, dropped, result)
        if seen != expected:
            raise RuntimeError("a partition of the documents changed between two passes: write them to a table first")
    return run


def line_decisions(docs: DataFrame, carry: list[str] | None = None, least: int = LEAST, digest: bool = False,
                   partitions: int | None = None) -> DataFrame:
    """``__row`` (the ``carry`` columns of ``docs``, all by default, as a struct), n_lines, n_dropped and
    ``kept``: the text without its dropped lines, or with ``digest`` that text's SHA-256.

    ``docs`` has doc_id (a number or a string), text and any other columns.  Lines end at \\n; a null or
    empty text is one empty line (a null text stays null, its digest is that of the empty text).  A line
    whose key has ``least`` code points or more stays only in rows whose doc_id is the smallest that holds
    the key: rows that share a doc_id count as one document, rows without one as one last document.  All
    lines of that document stay, repeats too.  An empty table gives no rows; a text's length is bounded
    by memory alone.  Both passes read ``docs``: it must be partitioned alike each time, as a file scan
    is; if a partition's rows differ between the passes, the job fails.
    """
    spark = docs.sparkSession
    carry = docs.columns if carry is None else carry
    fields = list(dict.fromkeys([*carry, "doc_id", "text"]))
    source = docs.select(*[F.col(f"`{c}`") for c in fields])
    kind = source.schema["doc_id"].dataType.simpleString()
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    with batch_rows(spark):
        keys = materialize(
            source.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0).cast(kind)).alias("doc"), "text")
            .mapInArrow(_keys(least), f"h1 long, h2 long, no_id boolean, doc {kind}, rid long, pos int, n_rows long, total long"),
            "line-keys")
    order = ["h1", "h2", "no_id", "doc", "rid"]
    found = materialize(
        keys.where("pos >= 0").select(*order, "pos").repartitionByRange(partitions, *order).sortWithinPartitions(*order)
        .mapInArrow(_stream, f"kind int, h1 long, h2 long, no_id boolean, doc {kind}, rid long, bits binary"), "line-bitmaps")
    edges = (found.where(F.col("kind") == EDGE).groupBy(F.col("h1").alias("e1"), F.col("h2").alias("e2"))
             .agg(F.min(F.struct("no_id", "doc")).alias("first")))
    settled = (found.where(F.col("kind") == OPEN).join(edges, (F.col("h1") == F.col("e1")) & (F.col("h2") == F.col("e2")))
               .where(F.struct("no_id", "doc") != F.col("first")))
    answers = (found.where(F.col("kind") == DROPPED).select("rid", "bits").unionByName(settled.select("rid", "bits"))
               .select("rid", F.lit(None).cast("long").alias("n_rows"), F.lit(None).cast("long").alias("total"), "bits")
               .unionByName(keys.where("pos < 0").select("rid", "n_rows", "total", F.lit(None).cast("binary").alias("bits"))))

    rows = source.rdd
    senders = rows.getNumPartitions()
    to_sender = (answers.rdd.map(lambda r: (r[0] >> PLACE_BITS, (r[0], r[1], r[2], None if r[3] is None else bytes(r[3]))))
                 .partitionBy(senders, lambda sender: sender))
    padding = to_sender.getNumPartitions() - senders
    if padding > 0:
        rows = rows.union(spark.sparkContext.parallelize([], padding))
    text_at, wanted = fields.index("text"), [fields.index(c) for c in carry]
    schema = T.StructType([T.StructField(f"c{i}", source.schema[c].dataType) for i, c in enumerate(carry)]
                          + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()),
                             T.StructField("kept", T.StringType())])
    judged = spark.createDataFrame(
        rows.zip(to_sender.mapPartitions(_deliver)).mapPartitions(_apply(text_at, wanted, least, digest)),
        schema, verifySchema=False)
    return judged.select(F.struct(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)]).alias("__row"),
                         "n_lines", "n_dropped", "kept")


def deduplicated_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """All rows and columns of ``docs``, each text without the lines that :func:`line_decisions` drops."""
    others = [F.col("kept").alias("text") if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns]
    return line_decisions(docs, least=least).select(*others)


def line_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 for every row of ``docs``, as :func:`line_decisions` has it."""
    return line_decisions(docs, carry=["doc_id"], digest=True).select(
        "__row.doc_id", "n_lines", "n_dropped", F.col("kept").alias("kept_sha256"))
