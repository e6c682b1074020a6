"""Prompt embeddings: cache keys, cache misses, the hash embedder and encoder plug-in.

The cache is a table ``(hash, embedding_model, prompt, embedding)``; lookups
are joins on ``hash``, inserts are appends of the misses only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routelens.functions.hashing import cache_key

HASH_DIM = 32


def with_cache_key(df: DataFrame, prompt_col: str, embedding_model: str) -> DataFrame:
    return df.withColumn("hash", cache_key(F.col(prompt_col), F.lit(embedding_model)))


def cache_misses(prompts: DataFrame, store: DataFrame, embedding_model: str, prompt_col: str = "prompt") -> DataFrame:
    """Distinct prompts (by cache key) that the store does not hold for this model."""
    keys = with_cache_key(prompts.select(prompt_col), prompt_col, embedding_model)
    keys = keys.groupBy("hash").agg(F.min(prompt_col).alias("prompt"))
    held = store.where(F.col("embedding_model") == embedding_model).select("hash")
    return keys.join(held, "hash", "left_anti")


#: Tokens whose bucket and sign a task remembers.
KNOWN_TOKENS = 1 << 20


class _Buckets(dict):
    """Token -> bucket, or that plus ``dim`` where the token counts negatively."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, token: bytes) -> int:
        if len(self) >= KNOWN_TOKENS:
            self.clear()
        h = hashlib.md5(token, usedforsecurity=False).hexdigest()
        self[token] = at = int(h[:4], 16) % self.dim + (0 if h[4] < "8" else self.dim)
        return at


def hash_embed_weights(df: DataFrame, text_col: str, key: str, dim: int = HASH_DIM) -> DataFrame:
    """Signed bucket counts of the hash embedder per key (every key, token-less texts included).

    Tokens: whitespace runs of lower(text); md5 hex h; bucket = int(h[1..4], 16) mod dim;
    sign +1 if h[5] < '8' else -1.  A text's tokens are counted in one pass over its Arrow batch, a token
    that a task has met before is not hashed again, and one row of ``dim`` counts leaves per text; texts
    of one key are added up.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(dim)
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part, at, n = b.slice(s, 512), [], []
                for text in part.column("_text").to_pylist():
                    tokens = text.split() if text else ()      # ASCII white space, as in the regular expressions
                    at.extend(map(known.__getitem__, tokens))
                    n.append(len(tokens))
                rows = np.repeat(np.arange(len(n)), n) * (2 * dim)
                both = np.bincount(rows + np.array(at, dtype=np.int64), minlength=len(n) * 2 * dim).reshape(len(n), 2, dim)
                out = both[:, 0] - both[:, 1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * dim), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("_key"), lists], ["_key", "weights"])

    schema = T.StructType([T.StructField("_key", df.schema[key].dataType), T.StructField("weights", T.ArrayType(T.LongType()))])
    rows = df.select(F.col(key).alias("_key"), F.lower(F.col(text_col)).cast("binary").alias("_text")).mapInArrow(count, schema)
    sums = rows.groupBy("_key").agg(*[F.sum(F.col("weights")[i]).alias(f"_w{i}") for i in range(dim)])
    return sums.select(F.col("_key").alias(key), F.array(*[F.col(f"_w{i}") for i in range(dim)]).alias("weights"))


def normalize(vec: F.Column) -> F.Column:
    """L2-normalised float vector; the zero vector stays zero."""
    sq = F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    # a list of one holds the norm: named inside the lambda, it would be worked out again for every component
    return F.transform(F.array(F.sqrt(sq)), lambda nrm: F.transform(
        vec, lambda x: F.when(nrm > 0, x.cast("double") / nrm).otherwise(F.lit(0.0)).cast("float")))[0]


def hash_embed(df: DataFrame, text_col: str, key: str, dim: int = HASH_DIM) -> DataFrame:
    """``(key, embedding array<float>)`` with the deterministic hash embedder; texts without any
    token get the zero vector.  ``key`` should be unique (e.g. the cache key)."""
    w = hash_embed_weights(df, text_col, key, dim)
    return w.select(key, normalize(F.col("weights")).alias("embedding"))


def encoder_embed(df: DataFrame, text_col: str, key: str, encoder_factory: Callable, dim: int) -> DataFrame:
    """Embed with a user encoder on Arrow batches (``mapInPandas``).

    ``encoder_factory()`` is called once per partition task and must return a
    function ``list[str] -> 2-d array (n, dim)``; models are loaded per task,
    never shipped from the driver.
    """
    import pandas as pd

    def run(batches):
        enc = encoder_factory()
        for pdf in batches:
            vecs = np.asarray(enc(pdf[text_col].fillna("").tolist()), dtype=np.float32).reshape(len(pdf), dim)
            yield pd.DataFrame({key: pdf[key].values, "embedding": list(vecs)})

    key_type = df.schema[key].dataType.simpleString()
    return df.select(key, text_col).mapInPandas(run, schema=f"{key} {key_type}, embedding array<float>")


def embed_with_cache(prompts: DataFrame, store: DataFrame, embedding_model: str,
                     embed: Callable[[DataFrame], DataFrame], prompt_col: str = "prompt",
                     append_to: str | None = None) -> DataFrame:
    """Look prompts up in the store, embed only the misses (deduplicated), optionally append them
    to the store path, and return the prompts with their embedding (left join on the key)."""
    misses = cache_misses(prompts, store, embedding_model, prompt_col)
    new = embed(misses.select("hash", "prompt")).join(misses, "hash").select(
        "hash", F.lit(embedding_model).alias("embedding_model"), "prompt", "embedding")
    if append_to is not None:
        new.write.mode("append").partitionBy("embedding_model").parquet(append_to)
        full = prompts.sparkSession.read.parquet(append_to).where(F.col("embedding_model") == embedding_model)
        full = full.dropDuplicates(["hash"])       # a retried run may have appended a prompt twice
    else:
        full = store.where(F.col("embedding_model") == embedding_model).unionByName(new)
    full = full.select("hash", "embedding")
    keyed = with_cache_key(prompts, prompt_col, embedding_model)
    return keyed.join(full, "hash", "left")
