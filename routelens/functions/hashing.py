"""Deterministic hashing helpers shared by split, cascade and embedding cache."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _s(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def uniform01(*parts: Column | str) -> Column:
    """Uniform [0, 1) from the first 32 bits of md5(part1 | part2 | ...)."""
    h = F.md5(F.concat_ws("|", *[_s(p) for p in parts]))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long").cast("double") / F.lit(4294967296.0)


def cache_key(prompt: Column | str, embedding_model: Column | str) -> Column:
    """SHA-256 hex of prompt || model name: the embedding-cache key."""
    return F.sha2(F.concat(_s(prompt), _s(embedding_model)), 256)
