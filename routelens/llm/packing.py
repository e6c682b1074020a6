"""Best-fit packing by minimum bin slack.

Documents become token ids, long ones are cut, and the pieces are packed into sequences of at most
``capacity`` tokens.  A packing depends on lengths alone, and there are at most ``capacity`` of them:
the counts per length are the whole input of the search, whatever the corpus size.  Per bin, a bitset
subset-sum over the available lengths finds the fullest combination around the longest piece left;
it is removed as often as the counts allow before the next search.  Every removal leaves some length
with fewer pieces than the combination used, which bounds the searches (below 7,500 for 1024) and the
plan, independent of the number of documents.  The plan is then joined to the pieces by their rank
within their length.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelens.llm.common import as_row, bounded_batches, hash63, spread_rank
from routelens.session import materialize

CAPACITY = 1024
END = 2
#: Characters of a chunk without a space up to which tiktoken's merging is the faster one.
LONG_CHUNK = 20_000
#: The first character beyond the Latin blocks.
LATIN_END = "\u0250"


def chunks_of(text: str) -> list[str]:
    """``text`` cut before each space that precedes a non-space character.

    The byte-level pattern always starts a new word there (`` ?\\p{L}+`` and its like take at most
    one space; a run of white space before a word leaves its last space to the word), so encoding the
    chunks one by one gives the ids of the whole text.
    """
    parts = text.split(" ")
    out = [parts[0]] if parts[0] else []
    append = out.append
    for p in parts[1:]:
        if p and not p[0].isspace():
            append(" " + p)
        elif out:
            out[-1] += " " + p
        else:
            append(" " + p)
    return out


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes.

    ``path`` is a byte-level vocabulary for ``tokenizers``.  Where the same vocabulary lies beside it
    as ranks, chunks of Latin script go through ``tiktoken``, which gives the same ids several times
    as fast; other scripts, on which Unicode versions could differ, and very long runs without a space
    stay with ``tokenizers``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.fast = None
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding(os.path.basename(ranks), pat_str=public_tokenizers.PATTERN,
                                          mergeable_ranks=table, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> bytes:
        if not self.fast:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            chunks = chunks_of(text)
            if max(map(len, chunks), default=0) <= LONG_CHUNK and (text.isascii() or max(text) < LATIN_END):
                ids = self.fast(text)
            else:
                ids = []
                for c in chunks:
                    if len(c) <= LONG_CHUNK and (c.isascii() or max(c) < LATIN_END):
                        ids += self.fast(c)
                    else:
                        ids += self.tokenizer.encode(c, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of n > 0 ids: all full but the first."""
    k = -(-n // capacity)
    return [n - capacity * (k - 1)] + [capacity] * (k - 1)


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, tokenizer: str = "byte_bpe_50k.json",
                 with_ids: bool = True) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32, and ids (array) if asked for.

    Null text counts as empty; an empty document is the end id alone.  A repeated row gives its
    pieces again.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    tail = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib
        enc = _encoder(tokenizer_path(tokenizer))
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            ids = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = enc.encode(text.as_py() or "") + tail
                start = 0
                for piece, length in enumerate(cut_lengths(len(got) // 4, capacity)):
                    part = got[4 * start:4 * (start + length)]
                    for name, v in zip(out, (key, piece, start, length, zlib.crc32(part)), strict=True):
                        out[name].append(v)
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype("int64"))
                    start += length
            cols = [pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()),
                    *[pa.array(out[n], pa.int64()) for n in ("start", "length", "ids_crc32")]]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, [*out, *["ids"] * with_ids])

    return bounded_batches(docs).select("doc_id", "text").mapInArrow(run, schema)


def fullest(counts: np.ndarray, capacity: int, first: int) -> list[tuple[int, int]]:
    """The fullest multiset of available lengths (with ``first`` in it) that fits: [(length, uses)].

    Bit s of ``reach`` says that some multiset of the lengths seen so far sums to s.  Lengths go in
    from the longest, so that short pieces, which fit anywhere, are spared; the search stops as soon
    as the bin can be filled.
    """
    room = capacity - first
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, list[int]]] = []
    have = counts.copy()
    have[first] -= 1
    for length in np.flatnonzero(have[:room + 1])[::-1].tolist():
        if length == 0:
            continue
        seen = []
        for _ in range(min(int(have[length]), room // length)):
            seen.append(reach)
            grown = reach | (reach << length) & mask
            if grown == reach:
                seen.pop()
                break
            reach = grown
        steps.append((length, seen))
        if reach >> room:
            break
    total = reach.bit_length() - 1
    uses = {first: 1}
    for length, seen in reversed(steps):
        for before in reversed(seen):
            if before >> total & 1:
                continue
            uses[length] = uses.get(length, 0) + 1
            total -= length
    return sorted(uses.items(), reverse=True)


def slack_plan(counts: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Segments of the packing: pieces of ``length`` ranked from ``lo`` to ``hi`` - 1 go, ``uses`` to a
    bin, into the bins from ``bin`` on, at ``base`` + place x length."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    used, rows, bins = np.zeros(capacity + 1, dtype=np.int64), [], 0
    for first in range(capacity, 0, -1):
        while left[first]:
            combo = fullest(left, capacity, first)
            times = min(int(left[length]) // n for length, n in combo)
            base = 0
            for length, n in combo:
                rows.append((length, int(used[length]), int(used[length]) + times * n, n, bins, base))
                used[length] += times * n
                left[length] -= times * n
                base += length * n
            bins += times
    return pd.DataFrame(rows, columns=["length", "lo", "hi", "uses", "bin", "base"])


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (a written table with doc_id, piece, start, length,
    ids_crc32 and any other columns): one gapless sequence per bin, as few as minimum bin slack finds.

    Equal rows are pieces of their own; an empty table gives no rows; the other columns come back as they
    are, whatever their names (but for sequence_id and offset, which are replaced).
    """
    spark = pieces.sparkSession
    others = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    pieces = pieces.select(*[f"`{c}`" for c in others])
    counts = {r["length"]: r["n"] for r in
              pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= capacity rows
    plan = slack_plan(counts, capacity)
    tie = [F.col(f"__row.{c}") for c in ("doc_id", "piece", "start", "ids_crc32")]
    keyed = as_row(pieces).withColumns({"key": F.col("__row.length"), "bucket": F.lit(0), "h": hash63(*tie),
                                        "tie": F.struct(*tie)})
    ranked = spread_rank(keyed, keyed.select("key", "bucket", "h"))
    segments = spark.createDataFrame(
        plan.rename(columns={"length": "l0"}) if len(plan) else [],
        "l0 long, lo long, hi long, uses long, bin long, base long")
    on = (F.col("key") == F.col("l0")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    place = F.col("rank") - F.col("lo")
    return (ranked.join(F.broadcast(segments), on)  # its size is bounded by the capacity, see above
            .withColumn("sequence_id", F.col("bin") + F.floor(place / F.col("uses")).cast("long"))
            .withColumn("offset", F.col("base") + (place % F.col("uses")) * F.col("key"))
            .select("__row.*", "sequence_id", "offset"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end: int = END, tokenizer: str = "byte_bpe_50k.json",
                   with_ids: bool = True) -> DataFrame:
    """Tokenise, cut and pack ``docs``: one row per piece with its sequence and offset."""
    return pack(materialize(token_pieces(docs, capacity, end, tokenizer, with_ids), "pack-pieces"), capacity)


def packed_sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, ids (at most the capacity) and the pieces in their order.

    ``packed`` is the result of :func:`pack` with ids: a sequence holds at most the capacity's tokens and
    pieces, so that no group grows with the data; repeated documents are pieces of their own, a null doc_id
    stays null, and an empty table gives no rows.
    """
    ordered = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return (packed.groupBy("sequence_id").agg(ordered.alias("p"))
            .select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"),
                    F.transform("p", lambda x: F.struct(x.doc_id.alias("doc_id"), x.piece.alias("piece"),
                                                        x.offset.alias("offset"))).alias("pieces")))


def pack_digest(docs: DataFrame, **params) -> DataFrame:
    return pack_documents(docs, with_ids=False, **params).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
